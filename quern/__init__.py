"""Keyed tables, iterative learning and graph analytics as Spark DataFrames."""
