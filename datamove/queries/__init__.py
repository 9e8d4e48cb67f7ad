"""The registered queries: each reads the tables of a folder and returns a frame; most have an equivalent SQL text."""

from datamove.queries import base, corpus, flagship, functions, mapping, patterns, reconcile, relational, sources, streaming  # noqa: F401

QUERIES = base.QUERIES
ORACLE = base.ORACLE
