"""Registered queries: every operator over the whole given tables, most with equivalent SQL."""

from checks import canonical, extraction, neighbours, profiling, relations, streams

ALL_QUERIES, ALL_SQL = {}, {}
for module in (profiling, extraction, canonical, neighbours, relations, streams):
    ALL_QUERIES.update(module.QUERIES)
    ALL_SQL.update(module.SQL)
