"""Operators for large-scale training-data preparation.

Nothing outside this subpackage imports it; every module works on whole
tables and whole texts and keeps per-task memory bounded by a block of rows.
"""
