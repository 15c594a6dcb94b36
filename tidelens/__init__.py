"""Panel analytics on Spark: features, cross-sections, joins and research statistics."""
