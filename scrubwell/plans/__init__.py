"""Ordered cleaning steps."""
