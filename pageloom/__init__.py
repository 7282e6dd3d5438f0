"""Document-structure analytics expressed as Spark DataFrame transformations."""
