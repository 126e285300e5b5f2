"""Gridded climate analytics as plain Spark DataFrame transformations."""
