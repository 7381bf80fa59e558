"""Column functions: no state, no jobs."""
