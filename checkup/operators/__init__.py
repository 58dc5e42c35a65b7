"""Relational operators: profiling, inference, catalog, plan rules, history, diffs."""
