"""Operators for training-data pipelines over the text tables.

One module per operator, each with its own general interface and a thin
registered query (``llm/queries.py``).  Nothing outside this subpackage
imports it.
"""
