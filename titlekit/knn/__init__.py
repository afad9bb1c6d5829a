"""Nearest-neighbour search over vector columns."""
