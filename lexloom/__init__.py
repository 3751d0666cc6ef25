"""Citation analytics and corpus processing on Spark DataFrames."""
