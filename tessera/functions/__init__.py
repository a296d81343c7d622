"""Column-level building blocks (pure Spark SQL expressions, no Python UDFs)."""
