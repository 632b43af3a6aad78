"""Operators for preparing training text at scale, each built by a named method.

Nothing else in the library imports this subpackage. Its queries and their DuckDB
statements are in ``queries``; ``corpus_pipeline.py`` at the repository top chains
five of the operators.
"""
