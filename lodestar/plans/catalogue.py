"""All registered queries by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import shared_dir


def _prepared(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        shared_dir(spark)
        return query(spark, sf)

    run.__name__, run.__doc__ = query.__name__, query.__doc__
    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from . import code, graphs, incremental, ranking, records, replay, repository, rules, state, streams, texts

    merged: dict[str, Callable] = {}
    for module in (ranking, texts, graphs, rules, state, code, streams, records, replay, incremental, repository):
        merged.update(module.QUERIES)
    return {name: _prepared(q) for name, q in merged.items()}
