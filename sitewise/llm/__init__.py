"""Operators for training data: percentiles, tokenization, mixing and content scores."""
