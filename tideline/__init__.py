"""Time-indexed message analytics expressed as Spark DataFrame plans."""
