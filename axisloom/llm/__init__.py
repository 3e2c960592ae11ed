"""Operators for training-data pipelines. Nothing else in axisloom imports this subpackage."""
