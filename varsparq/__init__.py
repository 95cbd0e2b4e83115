"""Population variant analytics as plain PySpark DataFrame operators."""
