"""Raster analytics on Spark: typed operation graphs compiled to DataFrames."""
