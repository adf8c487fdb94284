"""Composed jobs, recipes, table bindings and the query catalogue."""
