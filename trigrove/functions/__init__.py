"""Scalar functions: of columns, and of a request's literals."""
