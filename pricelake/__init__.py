"""Price-list analytics on Spark: sources, text and number functions, matching, versioning, quality and queries."""
