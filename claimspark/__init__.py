"""Statement-level consistency measurement as Spark DataFrame operators."""
