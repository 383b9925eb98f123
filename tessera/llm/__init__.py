"""Operators for training-data pipelines. Nothing else in tessera imports this subpackage."""
