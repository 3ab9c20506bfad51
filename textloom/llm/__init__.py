"""Operators for preparing text training data at scale.

Each module holds one operator; :mod:`textloom.llm.queries` applies them to the
driver's tables.  Nothing outside this subpackage imports it.
"""
