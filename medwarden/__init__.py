"""Drug-safety analytics as PySpark DataFrame and Structured Streaming operators."""

__version__ = "0.1.0"
