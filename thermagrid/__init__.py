"""Spark-native analytics for land-surface temperature tables.

Every operator takes DataFrames and column names and returns a DataFrame, so
the same code runs on landed satellite / weather tables and on any other table
with the same shape.
"""
