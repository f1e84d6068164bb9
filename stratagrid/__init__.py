"""Spark-first spatial analytics engine: scans, clouds, grids, meshes and paths as DataFrames."""
