"""The dialect's functions as Spark SQL expressions, and Column helpers for comparison by its rules."""
