"""Joins, aggregations and other operators that take and return DataFrames."""
