"""Filtered nearest-neighbour search as DataFrame algebra."""
