"""Scalar functions as Columns, and numpy kernels where Spark has no primitive."""
