"""Road-traffic analytics as PySpark DataFrame operators."""
