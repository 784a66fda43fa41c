"""Raster co-registration analytics on Spark DataFrames."""
