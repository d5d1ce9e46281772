"""Operators for preparing text and vectors for model training."""
