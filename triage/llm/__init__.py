"""Operators of a training-data pipeline over documents, pages and embeddings.

Nothing outside this subpackage imports it. Every operator reads only the
columns it names (extra input columns, whatever they are called, are ignored).
"""
