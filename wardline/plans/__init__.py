"""Cohort descriptions to predicates, and the query catalogue."""
