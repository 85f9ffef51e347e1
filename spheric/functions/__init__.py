"""Scalar functions of the grid as SQL expressions."""
