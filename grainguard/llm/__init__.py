"""Operators that a pipeline for training data needs: sharding, de-duplication, filters, tokens."""
