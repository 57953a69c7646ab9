"""Docketry operators."""
