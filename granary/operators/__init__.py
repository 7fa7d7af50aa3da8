"""Operators that plain Spark SQL doesn't have in one piece."""
