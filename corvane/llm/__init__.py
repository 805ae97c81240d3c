"""Operators for large-scale training-data preparation.

Nothing outside this subpackage imports it.  Every operator takes and returns
DataFrames; ``corvane.llm.queries`` holds the thin registered queries.
"""
