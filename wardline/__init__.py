"""Wardline: patient-level analytics, literature retrieval and corpus preparation on Spark."""
