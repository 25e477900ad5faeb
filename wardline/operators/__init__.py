"""Relational operators: patient ETL, retrieval, sampling, validation, graph."""
