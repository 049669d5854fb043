"""Operators of a large-scale training-data pipeline.

The subpackage stands alone: nothing else in the library imports it. Operators keep
general interfaces; the thin registered queries are in ``llm.queries``.
"""
