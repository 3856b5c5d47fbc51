"""Evidence and memory analytics as Spark jobs: DataFrames in, DataFrames out."""
