"""paceline: per-entity performance histories on PySpark."""
