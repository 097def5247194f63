"""Operators for preparing language-model training corpora.

Nothing outside this subpackage imports it; the queries that apply the operators
to the driver's tables are in :mod:`tallymill.llm.queries`.
"""
