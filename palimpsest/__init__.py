"""Document analytics on Spark: detection, chunking, matching and substitution over DataFrames."""

__version__ = "0.1.0"
