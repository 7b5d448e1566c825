"""Code-usage lineage at scale: DataFrames in, DataFrames out."""
