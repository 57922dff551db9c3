"""Queries composed of the operators, bound to the driver's tables."""
