"""Readers, writers and the clinical views over the driver tables."""
