"""Operators for preparing language-model training data.

Nothing outside this subpackage imports it: the folder, its tests and
``corpus_pipeline.py`` can be removed without touching the rest of the library.
"""
