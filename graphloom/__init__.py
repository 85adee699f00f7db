"""Property graphs on Spark: a query language over DataFrames, graph algorithms, search, and bulk load."""

VERSION = "0.1.0"
