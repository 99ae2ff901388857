"""Corpus-preparation operators for language-model training data.

Nothing else in ``clearprose`` imports this subpackage; it can be removed
together with ``tests/llm`` and ``corpus_pipeline.py``.
"""
