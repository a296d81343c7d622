"""Operators of a training-data pipeline, each usable on its own.

``queries.QUERIES`` registers them; nothing outside this package imports it
except the guarded import of ``__spark_entry__`` and ``corpus_pipeline``.
"""
