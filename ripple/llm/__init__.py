"""Operators for large-scale training-data pipelines.

Nothing outside this package imports it; ``__spark_entry__`` registers its
queries only where the package is present.
"""
