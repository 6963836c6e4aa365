"""Spatial bucketing, graph coverage, rules and corpus operators on Spark."""
