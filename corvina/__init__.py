"""API contract analytics as Spark DataFrame operators."""
