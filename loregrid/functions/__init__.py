"""Scalar functions as Column expressions, and the pure Python rules that the driver side needs."""
