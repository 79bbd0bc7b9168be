"""stellate: vector, table and versioned-data analytics on PySpark."""

__version__ = "0.1.0"
