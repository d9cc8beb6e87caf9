"""Operators for training-data pipelines. Nothing else in larkgrid imports this package."""
