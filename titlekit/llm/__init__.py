"""Operators on training text, and their queries. Nothing outside this folder imports it."""
