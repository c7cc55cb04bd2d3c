"""Retail analytics on Spark: sources, keyed merges, star schema, reports and alert rules as DataFrame plans."""
