"""News-analytics operators over Spark DataFrames."""
