"""Verbs on result frames: filter, select, merge and bind, each with its disclosure check."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .filters import compile_filter
from .gate import DisclosureError, Policy, assert_min_persons, safe_levels


def filter_rows(df: DataFrame, column: str, op: str, value, policy: Policy = Policy(), person: str = "person_id") -> DataFrame:
    """Rows by a test on a text column of few levels; both sides of the split must be large enough."""
    if op not in ("==", "!=", "in", "not_in") or dict(df.dtypes)[column] != "string":
        raise DisclosureError("only text columns can be tested, for equality or membership")
    safe_levels(df, column, policy, person)
    test = compile_filter({"column": column, "op": op, "value": value}, df)
    for side in (test, ~test):
        assert_min_persons(df.where(side), policy, person)
    return df.where(test)


def select_columns(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = ("person_id",)) -> DataFrame:
    """The columns asked for; keys stay."""
    return df.select(*dict.fromkeys([k for k in keys if k in df.columns] + list(columns)))


def merge(a: DataFrame, b: DataFrame, keys: Sequence[str] = ("person_id",), how: str = "inner") -> DataFrame:
    """Inner or left join on the keys; refused where neither side has unique keys."""
    unique = lambda df: df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count() == 0
    if not unique(a) and not unique(b):
        raise ValueError("both frames repeat their keys")
    return a.join(b, list(keys), how)


def bind_rows(frames: Sequence[DataFrame], policy: Policy = Policy(), person: str = "person_id") -> DataFrame:
    """Rows of frames with the same columns and types, gated again."""
    out = frames[0]
    for f in frames[1:]:
        if dict(f.dtypes) != dict(out.dtypes):
            raise ValueError("the frames differ in columns or types")
        out = out.unionByName(f)
    assert_min_persons(out, policy, person)
    return out


def to_cohort(df: DataFrame, periods: DataFrame, person: str = "person_id") -> DataFrame:
    """The observation periods of a frame's distinct persons, as a cohort."""
    p = df.select(F.col(person).alias("person_id")).distinct()
    return periods.join(p, "person_id", "left_semi").select(F.col("person_id").alias("subject_id"), F.col("observation_period_start_date").alias("cohort_start_date"), F.col("observation_period_end_date").alias("cohort_end_date")).distinct()


def recode(df: DataFrame, column: str, levels: Sequence[str], other: str | None = None) -> DataFrame:
    """A text column on an agreed list of levels; others become other."""
    return df.withColumn(column, F.when(F.col(column).isin(list(levels)), F.col(column)).otherwise(F.lit(other)))
