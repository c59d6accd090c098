"""Column expressions shared by the plans, with SQL twins where the catalog needs them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def persons(column: str = "person_id", name: str = "n_persons") -> Column:
    """Distinct persons."""
    return F.countDistinct(column).alias(name)


def records(name: str = "n_records") -> Column:
    """Rows."""
    return F.count(F.lit(1)).alias(name)


def long_count(mask: Column, name: str) -> Column:
    """Rows where mask holds."""
    return F.count(F.when(mask, 1)).alias(name)


def day_diff(later: Column, earlier: Column) -> Column:
    """Whole days from earlier to later."""
    return F.datediff(later, earlier).cast("long")


def floor_bin(value: Column, width: float) -> Column:
    """The lower edge of the bin of a width that holds value; negative values go down, not to zero."""
    return (F.floor(value / F.lit(width)) * width).cast("long")


def month_key(day: Column) -> Column:
    """YYYYMM as a number."""
    return (F.year(day) * 100 + F.month(day)).cast("long")


def quarter_label(day: Column) -> Column:
    """YYYY-Qn."""
    return F.concat(F.year(day).cast("string"), F.lit("-Q"), F.quarter(day).cast("string"))


def age_ladder(age: Column, last: int = 80) -> Column:
    """Decades as text, open from last on; ages below 10, negative ones too, are in the first."""
    out = F.when(age < 10, "0-9")
    for low in range(10, last, 10):
        out = out.when(age < low + 10, f"{low}-{low + 9}")
    return out.otherwise(f"{last}+")


def age_ladder_sql(age: str, last: int = 80) -> str:
    """The ladder in SQL."""
    steps = " ".join(f"WHEN {age} < {low + 10} THEN '{low}-{low + 9}'" for low in range(0, last, 10))
    return f"CASE {steps} ELSE '{last}+' END"


def concept_label(name: Column) -> Column:
    """A concept's name as a safe column name: lower case, other than letters and digits one underscore."""
    return F.regexp_replace(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "_"), "^_+|_+$", "")
