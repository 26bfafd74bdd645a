"""Road-network analytics and route planning on Spark DataFrames."""
