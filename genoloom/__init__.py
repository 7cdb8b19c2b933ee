"""Gene-gene relationship analytics on Spark DataFrames in long form."""
