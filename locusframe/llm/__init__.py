"""Operators for building training corpora: deduplication, mixing, sharding, tokens, languages.

Everything here stands on Spark and the standard columns only; the rest of the library
does not import this subpackage.
"""
