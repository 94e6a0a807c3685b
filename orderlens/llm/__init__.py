"""Operators of a training-data pipeline over whole document tables.

Nothing outside this subpackage (and ``corpus_pipeline.py``) imports it.
"""
