"""foliomill: label and score large document collections with PySpark."""

__version__ = "0.1.0"
