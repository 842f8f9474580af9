"""millrace: a relational analytics engine expressed on Spark DataFrames and Spark SQL."""

__version__ = "0.1.0"
