"""Operators for building text training sets.

Nothing outside this folder imports it; ``evidra.llm.queries`` lists the queries
and their SQL for the entry module.
"""
