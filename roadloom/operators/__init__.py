"""Operators over road networks, route segments and search traces."""
