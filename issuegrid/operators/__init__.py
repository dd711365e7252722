"""Operators: DataFrame(s) in, DataFrame out. No collect, no Python UDF."""
