"""Operators for preparing training corpora: one module each, plus `queries`.

Nothing outside this folder and ``corpus_pipeline.py`` imports it.
"""
