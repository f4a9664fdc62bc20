"""Credit-application analytics as Spark DataFrame operators."""
