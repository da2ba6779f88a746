"""Operators for training-data pipelines over document, vector and label tables."""
