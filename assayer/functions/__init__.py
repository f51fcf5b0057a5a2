"""Column functions whose meaning differs from Spark's defaults."""
