"""Document-extraction analytics as Spark DataFrame operators."""
