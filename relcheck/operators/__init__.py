"""Operators on whole tables: coercion, validation and the declaration that they work from."""
