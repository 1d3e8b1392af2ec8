"""tidemark: analytics operators written as plain Spark DataFrame plans."""

__version__ = "0.1.0"
