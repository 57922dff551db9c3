"""Orrery: entity-to-catalog matching analytics on Spark DataFrames."""
