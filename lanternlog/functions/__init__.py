"""Column expressions: predicates, field paths, addresses, display projections."""
