"""lodestar — listing-data cleaning, classification, dedup, upsert and matching on Spark.

Every operator is a function over DataFrames / Columns built from native Spark
expressions, joins and windows; column names are parameters.
"""

__version__ = "0.1.0"
