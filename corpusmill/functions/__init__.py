"""Column functions: text, keys, JSON and schema checks."""
