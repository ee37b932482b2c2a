"""Queries and how they become DataFrames."""
