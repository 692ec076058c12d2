"""quillon: exact top-k grouped aggregation on Spark, with sound pruned plans."""

__version__ = "0.1.0"
