"""Price-list analytics on Spark: parse, match, validate, version, search and compare priced services."""
