"""Entity-text analytics as Spark DataFrame operators."""
