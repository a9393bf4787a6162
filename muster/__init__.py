"""Alliance analytics, capture repair and roster resolution on Spark."""
