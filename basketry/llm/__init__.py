"""Operators for preparing language-model training corpora.

Nothing else in the library imports this subpackage; delete it together with
``corpus_pipeline.py`` and ``tests/llm`` and the rest keeps working.
"""
