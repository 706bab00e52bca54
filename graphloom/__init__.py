"""graphloom: typed graphs derived from flat fact tables, on PySpark."""

__version__ = "0.1.0"
