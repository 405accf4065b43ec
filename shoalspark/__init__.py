"""Water-depth mapping on Spark: points, pixels and profiles as DataFrames."""
