"""Operators of a training-data pipeline: quality, private data, toxicity, near-duplicates, neighbours, mixing, tokens.

Each module holds one operator with its own general interface. `queries` registers one query per operator over its whole
table, and nothing outside this folder (but corpus_pipeline.py) imports it."""
