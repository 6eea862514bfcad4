"""tallyglass: code-intelligence analytics over text and source tables, Spark-first."""

__version__ = "0.1.0"
