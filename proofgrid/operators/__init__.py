"""DataFrame operators: rule scan, cases, coverage, history, liveness."""
