"""Nearest-neighbour analytics over dense vectors, as plain PySpark DataFrames."""
