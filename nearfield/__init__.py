"""nearfield: vector search and data processing expressed as Spark DataFrame plans."""
