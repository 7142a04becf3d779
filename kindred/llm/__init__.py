"""Operators for preparing language-model training data.

Nothing outside this folder imports it; the queries over the test tables are in
``kindred.llm.queries``.
"""
