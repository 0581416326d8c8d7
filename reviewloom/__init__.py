"""Review-feedback analytics as Spark DataFrame operators."""
