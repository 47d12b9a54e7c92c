"""Expressions and building blocks that operators are composed of."""
