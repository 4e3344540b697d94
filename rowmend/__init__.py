"""Detection and repair of bad rows in wide mixed-type tables, as Spark jobs."""
