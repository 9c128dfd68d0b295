"""Quarterly financial analytics on Spark: series, windows, structures, quality rules and text operators."""
