"""Live, ordered, bounded list queries on PySpark."""
