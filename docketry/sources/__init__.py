"""Docketry sources."""
