"""All queries of the clinical engine by name, each with its DuckDB SQL where SQL expresses it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .plans import catalog, clinical, standard, templates
from .sources.cdm import Cdm, with_views

Query = Callable[[SparkSession, str], DataFrame]


def _on_cdm(build: Callable[[Cdm], DataFrame]) -> Query:
    return lambda spark, sf_dir: build(Cdm(spark, sf_dir))


def all_queries() -> dict[str, tuple[Query, str | None]]:
    """Name to query and SQL."""
    out: dict[str, tuple[Query, str | None]] = {}
    for t in templates.catalog().values():
        out[t.name] = (_on_cdm(t.build), with_views(t.sql))
    for a in standard.catalog().values():
        out[a.name] = (_on_cdm(a.build), with_views(a.sql))
    for name, (build, sql) in {**clinical.catalog(), **catalog.catalog()}.items():
        out[name] = (_on_cdm(build), with_views(sql) if sql else None)
    return out
