"""Scalar functions by domain. Each is a Column expression unless its docstring says that it runs in Python."""
