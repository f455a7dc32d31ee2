"""loomkit: an analytics layer of pluggable functions, sources and catalogs on PySpark."""

__version__ = "0.1.0"
