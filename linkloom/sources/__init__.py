"""Readers, writers and views of the driver tables."""
