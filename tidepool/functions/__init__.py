"""Predicates, orders and values as Spark columns."""
