"""Operators of a training-data pipeline: cleaning, scoring, near-duplicates, mixing and binary output.

One module per operator; ``queries`` registers them over the ``documents`` and ``embeddings`` tables.
Nothing outside this package imports it.
"""
