"""paritas: data-consistency checks and data-set operations as Spark plans."""

__version__ = "0.1.0"
