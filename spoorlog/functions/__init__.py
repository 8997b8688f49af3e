"""Column expressions: text, dates, predicates and vectors."""
