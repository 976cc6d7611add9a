"""Transformations of whole tables: every function takes and returns DataFrames."""
