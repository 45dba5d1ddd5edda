"""Branching spatial data on Spark: trees of 3-D points, voxel grids, region hierarchies.

Every operator takes DataFrames and returns a DataFrame.  Only the iterative ones run
jobs while they are being called; the rest stay lazy until the caller acts on them.
"""
