"""Column functions and the few pandas UDFs that Spark SQL has no counterpart for."""
