"""Operators of a training-data pipeline: scoring, deduplication, packing, filtering.

Nothing else in the library imports this subpackage. Its queries are in
:mod:`lattica.llm.queries`; ``corpus_pipeline.py`` chains five of the operators.
"""
