"""The filter language: nested specs compiled to one Column, for rows, features and populations alike."""

from __future__ import annotations

import datetime as dt
import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_DEPTH, MAX_NODES, MAX_VALUES = 32, 1024, 10_000
COMPARE = {"==": "eq", "!=": "ne", ">=": "gte", "<=": "lte", ">": "gt", "<": "lt"}
#: Thresholds order persons by a value, so only the server may use them.
INTERNAL_ONLY = {"gte", "lte", "gt", "lt"}
_IDENTIFIER = re.compile(r"^[A-Za-z_][A-Za-z0-9_]*$")


class FilterError(ValueError):
    """A spec that isn't allowed."""


def complexity(spec: dict, depth: int = 1) -> tuple[int, int, int]:
    """Depth, nodes and values of a spec."""
    if "filters" in spec:
        parts = [complexity(s, depth + 1) for s in spec["filters"]]
        return max([depth, *(p[0] for p in parts)]), 1 + sum(p[1] for p in parts), sum(p[2] for p in parts)
    value = spec.get("value")
    return depth, 1, len(value) if isinstance(value, (list, tuple)) else 1


def validate(spec: dict, df: DataFrame, public: bool = True, blocked: frozenset[str] = frozenset()) -> None:
    """Raises FilterError unless the spec is within the caps and names only columns and operators it may."""
    depth, nodes, values = complexity(spec)
    if depth > MAX_DEPTH or nodes > MAX_NODES or values > MAX_VALUES:
        raise FilterError("the filter is too large")
    _check(spec, dict(df.dtypes), public, blocked)


def _check(spec: dict, types: dict[str, str], public: bool, blocked: frozenset[str]) -> None:
    if "filters" in spec:
        if spec.get("op", "and").lower() not in ("and", "or"):
            raise FilterError(f"unknown group {spec.get('op')!r}")
        for s in spec["filters"]:
            _check(s, types, public, blocked)
        return
    column, op = spec.get("column", ""), COMPARE.get(spec.get("op", ""), spec.get("op", ""))
    if not _IDENTIFIER.match(column) or column not in types or column in blocked:
        raise FilterError(f"column {column!r} can't be filtered")
    if op not in {*COMPARE.values(), "in", "not_in", "between", "is_null", "not_null", "value_bin"}:
        raise FilterError(f"unknown operator {spec.get('op')!r}")
    if public and (op in INTERNAL_ONLY or op == "between" and types[column] not in ("date", "timestamp", "timestamp_ntz")):
        raise FilterError(f"{op} is not allowed on {column}")
    if public and op in ("in", "not_in") and not column.endswith("_concept_id") and types[column] != "string":
        raise FilterError(f"{op} needs a concept or text column")


def _leaf(spec: dict, types: dict[str, str]) -> Column:
    c, op, value = F.col(spec["column"]), COMPARE.get(spec["op"], spec["op"]), spec.get("value")
    if op == "is_null":
        return c.isNull()
    if op == "not_null":
        return c.isNotNull()
    if op == "in":
        return c.isin(list(value)) if value else F.lit(False)
    if op == "not_in":
        return ~c.isin(list(value)) if value else F.lit(True)
    if op == "value_bin":
        return (c >= value[0]) & (c < value[1])
    if op == "between":
        if types.get(spec["column"]) in ("date", "timestamp", "timestamp_ntz"):
            low, high = (dt.date.fromisoformat(str(v)) for v in value)
            return (c >= F.lit(low)) & (c < F.lit(high + dt.timedelta(days=1)))
        return c.between(*value)
    return {"eq": c == value, "ne": c != value, "gte": c >= value, "lte": c <= value, "gt": c > value, "lt": c < value}[op]


def compile_filter(spec: dict, df: DataFrame) -> Column:
    """The predicate of a spec; unknown comparisons (of nulls) drop the row, as in SQL."""
    types = dict(df.dtypes)

    def build(s: dict) -> Column:
        if "filters" not in s:
            return _leaf(s, types)
        parts = [build(x) for x in s["filters"]]
        both = s.get("op", "and").lower() == "and"
        return reduce((lambda a, b: a & b) if both else (lambda a, b: a | b), parts) if parts else F.lit(both)

    return build(spec)


def apply_filter(df: DataFrame, spec: dict, public: bool = True, blocked: frozenset[str] = frozenset()) -> DataFrame:
    """Rows that satisfy a validated spec."""
    validate(spec, df, public, blocked)
    return df.where(compile_filter(spec, df))


def time_window(df: DataFrame, column: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """Rows whose day lies in [start, end]; the whole last day counts, for times too."""
    if start is not None:
        df = df.where(F.col(column) >= F.lit(dt.date.fromisoformat(start)))
    if end is not None:
        df = df.where(F.col(column) < F.lit(dt.date.fromisoformat(end) + dt.timedelta(days=1)))
    return df


def of_concepts(df: DataFrame, column: str, concepts: list[int] | DataFrame) -> DataFrame:
    """Rows of a concept set: a literal list when short, else a semi join; an empty list keeps nothing."""
    if isinstance(concepts, DataFrame):
        return df.join(concepts.select(F.col(concepts.columns[0]).alias("_c")), F.col(column) == F.col("_c"), "left_semi")
    return df.where(F.col(column).isin(concepts) if concepts else F.lit(False))


def in_cohort(df: DataFrame, cohort: DataFrame, person: str = "person_id") -> DataFrame:
    """Rows of a cohort's persons."""
    return df.join(cohort.select(F.col("subject_id").alias("_s")), F.col(person) == F.col("_s"), "left_semi")


def during_visits(df: DataFrame, visits: DataFrame, visit_concepts: list[int]) -> DataFrame:
    """Rows recorded in a visit of the given kinds."""
    kept = visits.where(F.col("visit_concept_id").isin(visit_concepts)).select(F.col("visit_occurrence_id").alias("_v"))
    return df.join(kept, F.col("visit_occurrence_id") == F.col("_v"), "left_semi")
