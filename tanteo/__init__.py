"""League statistics on Spark: DataFrames in, DataFrames out."""
