"""Whole plans: networks, route generation, and the registry of queries."""
