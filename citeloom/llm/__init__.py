"""Operators for training-data pipelines. Nothing else in citeloom imports this package."""
