"""Extraction of rows from a table: which columns, which rows, in which form, with dates handled as asked."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import filters, temporal
from ..operators.gate import Policy, assert_min_persons
from ..sources.blueprint import Blueprint, TableInfo

MAX_ROWS = 1_000_000


class SpecError(ValueError):
    """A request that names what is not there or not allowed."""


def columns_of(info: TableInfo, wanted: Sequence[str] | Mapping[str, str] | None) -> dict[str, str]:
    """Source column to the name it lands under.

    Without a wish, all columns that may be seen.  Unknown columns and
    sensitive ones that are asked for are errors; the person and the table's own
    concept column always stay.
    """
    named = dict(wanted) if isinstance(wanted, Mapping) else {c: c for c in wanted} if wanted is not None else {c.name: c.name for c in info.columns if not c.sensitive}
    for name in named:
        column = info.column(name)
        if column is None:
            raise SpecError(f"{info.name} has no column {name}")
        if column.sensitive:
            raise SpecError(f"{name} is not released")
    forced = [c for c in ("person_id" if info.has_person else None, info.concept_column) if c]
    out = {c: named.get(c, c) for c in forced} | named
    if len(set(out.values())) < len(out):
        raise SpecError("two columns land under one name")
    return out


def generic_dates(spec: dict, info: TableInfo) -> dict:
    """A filter spec with start_date and end_date standing for the table's own dates."""
    if "filters" in spec:
        return spec | {"filters": [generic_dates(s, info) for s in spec["filters"]]}
    own = {"start_date": info.date_column, "end_date": info.interval[1] if info.interval else info.date_column}
    named = own.get(spec.get("column", "")) if info.column(spec.get("column", "")) is None else None
    return spec | {"column": named} if named else spec


def classify(spec: dict, info: TableInfo) -> str:
    """allowed, constrained (a date or a bin, whose width must be checked) or blocked; a group is as its worst part."""
    if "filters" in spec:
        kinds = [classify(s, info) for s in spec["filters"]]
        return next((k for k in ("blocked", "constrained") if k in kinds), "allowed")
    column = info.column(spec.get("column", ""))
    op = filters.COMPARE.get(spec.get("op", ""), spec.get("op", ""))
    if column is None or column.sensitive or op in filters.INTERNAL_ONLY:
        return "blocked"
    if op == "between":
        return "constrained" if column.is_date else "blocked"
    return "constrained" if op == "value_bin" else "allowed"


def check_bins(spec: dict, issued: Mapping[str, Sequence[float]]) -> None:
    """Raises unless every value_bin has neighbouring edges of those issued for its column."""
    for s in spec.get("filters", [spec]):
        if "filters" in s:
            check_bins(s, issued)
        elif s.get("op") == "value_bin":
            edges = list(issued.get(s["column"], ()))
            if not any([low, high] == list(s["value"]) for low, high in zip(edges, edges[1:])):
                raise SpecError("bin edges must be ones that were issued")


def extract(
    tables: Mapping[str, DataFrame],
    blueprint: Blueprint,
    table: str,
    columns: Sequence[str] | Mapping[str, str] | None = None,
    concepts: Sequence[int] | DataFrame | None = None,
    concept_column: str | None = None,
    where: dict | None = None,
    issued: Mapping[str, Sequence[float]] | None = None,
    cohort: DataFrame | None = None,
    window: tuple[str | None, str | None] | None = None,
    visits: Sequence[int] | None = None,
    select: tuple[int, str] | None = None,
    min_gap: int | None = None,
    dates: str = "absolute",
    unit: str = "month",
    limit: int | None = None,
    policy: Policy | None = Policy(),
) -> DataFrame:
    """Rows of a table.

    Concepts are matched in the table's own concept column unless another is
    named.  cohort keeps its persons; window days of the event date; visits
    those kinds of visit; select (n, first or last) events a person; min_gap one
    event of each chain.  dates: absolute, remove, binned, or relative to the
    cohort's first start.  With a policy the rows must have enough persons behind
    them, and filters are those that anyone may use.
    """
    if table not in blueprint:
        raise SpecError(f"no table {table}")
    if limit is not None and not 0 < limit <= MAX_ROWS:
        raise SpecError(f"the limit must be in 1 to {MAX_ROWS}")
    info = blueprint[table]
    landed = columns_of(info, columns)
    out = tables[table]
    if where is not None:
        where = generic_dates(where, info)
        if policy is not None:
            check_bins(where, issued or {})
        out = filters.apply_filter(out, where, policy is not None, frozenset(c.name for c in info.columns if c.sensitive))
    if concepts is not None:
        column = concept_column or info.concept_column
        if column is None or info.column(column) is None:
            raise SpecError(f"{table} has no concept column {column or ''}")
        out = filters.of_concepts(out, column, concepts)
    if cohort is not None:
        out = filters.in_cohort(out, cohort)
    if window is not None:
        out = filters.time_window(out, info.date_column, *window)
    if visits is not None:
        out = filters.during_visits(out, tables["visit_occurrence"], list(visits))
    if select is not None or min_gap is not None:
        keyed = out.withColumns({"event_date": F.col(info.date_column).cast("date"), "event_key": F.col(info.key)})
        by = ["person_id", *([info.concept_column] if info.concept_column else [])]
        if min_gap is not None:
            keyed = temporal.min_gap(keyed, by, min_gap)
        if select is not None:
            keyed = temporal.event_select(keyed, ["person_id"], select[0], select[1] == "last")
        out = keyed.drop("event_date", "event_key")
    if policy is not None and info.has_person:
        assert_min_persons(out, policy)
    if dates == "relative":
        if cohort is None:
            raise SpecError("relative dates need a cohort")
        first = cohort.groupBy(F.col("subject_id").alias("person_id")).agg(F.min("cohort_start_date").alias("_index"))
        out = out.join(first, "person_id")
        out = temporal.handle_dates(out.select(*landed, "_index"), "relative", index="_index").drop("_index")
    else:
        out = temporal.handle_dates(out.select(*landed), dates, unit=unit)
    out = out.withColumnsRenamed({a: b for a, b in landed.items() if a != b})
    return out if limit is None else out.limit(limit)
