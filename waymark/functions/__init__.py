"""Column-level helpers: predicates, scores and numeric guards."""
