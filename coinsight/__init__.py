"""Value-aware risk analytics as Spark DataFrame operators."""
