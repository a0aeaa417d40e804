"""Set-at-a-time analytics over 3-D scene data held as Spark DataFrames."""

__version__ = "0.1.0"
