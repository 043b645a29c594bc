"""Column-level building blocks: field lookup, predicates, conditions, time, scalars."""
