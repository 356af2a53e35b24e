"""Trip analytics on GPS logs, written as Spark DataFrame plans."""
