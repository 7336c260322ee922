"""Compositions of operators, plan helpers and the registered queries."""
