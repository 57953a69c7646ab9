"""Docketry plans."""
