"""Composed plans: the engine, derived relations, and the registered queries."""
