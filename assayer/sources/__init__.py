"""Where a table's rows come from, and how its rows are ordered."""
