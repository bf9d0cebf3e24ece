"""Readers, writers and the OMOP-shaped input tables."""
