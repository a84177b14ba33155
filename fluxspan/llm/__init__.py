"""Operators for training-data pipelines.  Nothing else in fluxspan imports this."""
