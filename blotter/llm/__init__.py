"""Operators of a large-scale training-data pipeline.

Each module holds one operator with a general interface (DataFrame in,
DataFrame out); :mod:`blotter.llm.queries` registers the thin ``opN_<name>``
queries over the driver's tables and their SQL. Nothing outside this
subpackage imports it.
"""
