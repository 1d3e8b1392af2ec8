"""Column functions and the few Arrow-batched helpers Spark has no built-in for."""
