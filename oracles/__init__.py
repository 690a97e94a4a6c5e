"""DuckDB statements that answer the catalogue's queries independently of Spark."""

from __future__ import annotations


def all_statements() -> dict[str, str]:
    from . import graphs, incremental, predict, ranking, records, replay, rules, state, streams, texts

    merged: dict[str, str] = {}
    for module in (ranking, predict, texts, graphs, rules, state, streams, records, replay, incremental):
        merged.update(module.STATEMENTS)
    return merged
