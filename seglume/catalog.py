"""All queries over the test tables, with the SQL that each must equal."""

from __future__ import annotations

from seglume.plans import audits, likeness, lineages, progress, relations, sequences, sources_sinks, texts, timelines

MODULES = (progress, relations, timelines, lineages, texts, sequences, sources_sinks, audits, likeness)


def queries() -> dict:
    return {name: run for m in MODULES for name, (run, _) in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, (_, sql) in m.QUERIES.items() if sql}


#: Queries that give no rows on the smallest tables.
MAY_BE_EMPTY: set[str] = set()
