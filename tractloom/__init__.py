"""Tract analytics on Spark: streamlines, voxel maps and acquisition tables as DataFrames."""

__version__ = "0.1.0"
