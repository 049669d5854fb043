"""Compares versions of a declared surface as DataFrame jobs."""
