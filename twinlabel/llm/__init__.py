"""Operators of a training-data pipeline: filtering, deduplication, archives, mixing.

Nothing outside this package imports it; its queries are in ``queries.py``.
"""
