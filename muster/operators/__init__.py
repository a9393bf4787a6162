"""Operators over DataFrames: views, reads, upserts, resolution, repair, calendar."""
