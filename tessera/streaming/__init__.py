"""Incremental forms of cohort aggregates over event streams."""
