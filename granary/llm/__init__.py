"""Operators for training-data pipelines. Nothing else in granary imports this subpackage."""
