"""Operators for large-scale training-data pipelines (language id, packing,
dedup, language-model scoring, tokenisation, vector search, extraction).

Nothing outside this folder imports it, apart from the guarded registration
in ``__spark_entry__.py`` and the top-level ``corpus_pipeline.py``.
"""
