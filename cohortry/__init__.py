"""Cohortry: leakage-safe clinical machine-learning analytics as Spark jobs."""

__version__ = "0.1.0"
