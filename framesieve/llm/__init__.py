"""Operators for training-data pipelines: deduplication, tokenisation, scoring, redaction.

Nothing else in the library imports this subpackage.  Queries live in
``framesieve.llm.queries``.
"""
