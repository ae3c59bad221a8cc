"""Operators for building training corpora: dedup, scoring, token accounting, mixing, packing, stores.

Nothing outside this package imports it.  ``tidebar.llm.queries`` registers one query per operator.
"""
