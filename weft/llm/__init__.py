"""Operators for training-data pipelines. Nothing else in weft imports this package."""
