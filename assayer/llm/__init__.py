"""Operators for preparing training text at scale.

Each module is one operator; :mod:`assayer.llm.registry` holds the queries and
their SQL.  Nothing outside this folder imports it.
"""
