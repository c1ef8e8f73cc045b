"""Category-graph analytics and data-pipeline operators on Spark DataFrames."""

__version__ = "0.1.0"
