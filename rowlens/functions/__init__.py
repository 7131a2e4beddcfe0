"""Column expressions: cell comparison and predicates."""
