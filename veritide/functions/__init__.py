"""Column builders: scalar functions, predicates, semantic validators."""
