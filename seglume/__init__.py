"""Segment analytics on Spark: ordered, timestamped text segments and their lineage."""
