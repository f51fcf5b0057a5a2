"""From a table's description to Spark plans and back to results."""
