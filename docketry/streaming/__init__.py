"""Docketry streaming."""
