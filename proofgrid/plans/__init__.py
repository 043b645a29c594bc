"""The operators bound to the benchmark tables, each with the SQL it must agree with."""
