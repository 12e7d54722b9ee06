"""Constraint-aware relational datasets on Spark: validate, generate, edit, update, store and ask."""
