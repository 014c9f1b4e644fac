"""Logical plans: the closed relation algebra."""
