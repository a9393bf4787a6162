"""Where tables come from: the driver tables mapped onto the domain, and capture files."""
