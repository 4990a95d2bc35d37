"""Operators of a training-data pipeline (deduplication, decontamination, packing, ...).

Nothing outside this subpackage imports it. ``registry`` holds its queries and SQL.
"""
