"""plumbline: drawing analytics and corpus preparation on Spark DataFrames."""
