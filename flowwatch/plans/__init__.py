"""Composed jobs, the query catalog and their SQL cross-checks."""
