"""Execution helpers and the registered queries."""
