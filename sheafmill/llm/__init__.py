"""Operators of a training-data pipeline over `documents`, `pages` and `benchmark` tables.

Nothing outside this subpackage imports it. `queries.py` registers one query per operator.
"""
