"""Operators for training data pipelines; see `queries` for the registered uses."""
