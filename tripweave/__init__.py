"""Batch analytics for GPS trajectories and map data on Spark DataFrames."""
