"""Search, ranking and corpus operators as PySpark DataFrame plans."""

__version__ = "0.1.0"
