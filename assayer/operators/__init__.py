"""Rules as Spark expressions and plans."""
