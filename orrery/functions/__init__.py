"""Scalar functions and the fixed vocabulary."""
