"""Column expressions: everything here takes and returns columns and is evaluated by Spark over whole tables."""
