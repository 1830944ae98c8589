"""Operators for training-data pipelines: ten of them, one module each."""
