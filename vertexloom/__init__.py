"""vertexloom: comparison, repair and audit of curves held as Spark DataFrames."""

__version__ = "0.1.0"
