"""Point-in-time analytics over revised, dated facts, as Spark DataFrame operators."""
