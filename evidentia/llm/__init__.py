"""Operators of a training-data pipeline.

Nothing else in the library imports this subpackage. Each operator module
has a general interface (its real outputs are texts, ids, spans, links or
files); the thin queries in :mod:`evidentia.llm.queries` derive the digest
columns from those outputs.
"""
