"""Operators for preparing text and vector training data. Nothing else in the package imports this one."""
