"""Registered queries: the operators on clinical views over the given tables."""
