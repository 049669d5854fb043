"""Readers, writers and derived test tables."""
