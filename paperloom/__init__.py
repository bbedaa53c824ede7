"""Document analytics on Spark: lines, sections, records, matching, ranking and validation."""
