"""Jobs over long tables: DataFrames in, DataFrames out."""
