"""Operators for large-scale training-text pipelines.  Nothing else in the package imports this."""
