"""Patient-level glucose and insulin-pump analytics as Spark DataFrame transformations."""
