"""Operators for preparing text corpora for training."""
