"""Person-bounded noisy releases: each person's contribution is bounded, then keyed discrete Laplace noise is added.

The noise is a function of a secret key and the canonical query, so asking
again gives the same answer.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import hmac
import json
import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAX_INTEGER = (1 << 53) - 1
GRID = 65535


def release_id(key: bytes, query: dict) -> str:
    """HMAC of the canonical query."""
    return hmac.new(key, json.dumps(query, sort_keys=True, separators=(",", ":")).encode(), hashlib.sha256).hexdigest()


def uniform(key: bytes, query: dict, label: str) -> float:
    """In (0, 1), from the key, the query and a label."""
    digest = hmac.new(key, (release_id(key, query) + "|" + label).encode(), hashlib.sha256).digest()
    return (int.from_bytes(digest[:8], "big") + 0.5) / (1 << 64)


def discrete_laplace(key: bytes, query: dict, label: str, epsilon: float, sensitivity: int = 1) -> int:
    """Two-sided geometric noise: the difference of two geometric variables."""
    q = math.exp(-epsilon / sensitivity)
    draw = lambda side: int(math.floor(math.log(uniform(key, query, f"{label}|{side}")) / math.log(q)))
    return draw("a") - draw("b")


def noisy(key: bytes, query: dict, label: str, value: int, epsilon: float, sensitivity: int = 1) -> int:
    """value with noise, within the integers that are safe everywhere."""
    return min(MAX_INTEGER, max(0, value + discrete_laplace(key, query, label, epsilon, sensitivity)))


def count_persons(df: DataFrame, person: str = "person_id") -> DataFrame:
    """One a person."""
    return df.agg(F.countDistinct(person).alias("value"))


def bounded_records(df: DataFrame, k: int, person: str = "person_id") -> DataFrame:
    """At most k records a person."""
    return df.groupBy(person).agg(F.least(F.count(F.lit(1)), F.lit(k)).alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("value"))


def reduce_person(df: DataFrame, value: str, how: str, order: Sequence[str] = (), person: str = "person_id") -> DataFrame:
    """One value a person: any, min, max, mean, median, mode, first or last."""
    key = F.struct(*order) if order else None
    agg: Column = {
        "any": lambda: F.max(value), "min": lambda: F.min(value), "max": lambda: F.max(value), "mean": lambda: F.avg(value),
        "median": lambda: F.percentile(value, 0.5), "mode": lambda: F.mode(value, True), "first": lambda: F.min_by(value, key), "last": lambda: F.max_by(value, key),
    }[how]()
    return df.where(F.col(value).isNotNull()).groupBy(person).agg(agg.alias("v"))


def categorical_histogram(df: DataFrame, column: str, levels: Sequence, k: int, order: Sequence[str], person: str = "person_id") -> DataFrame:
    """At most k records a person over a fixed list of levels, absent ones 0."""
    w = Window.partitionBy(person).orderBy(*order)
    kept = df.where(F.col(column).isin(list(levels))).withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= k)
    listed = df.sparkSession.createDataFrame([(x,) for x in levels], f"level {dict(df.dtypes)[column]}")
    counts = kept.groupBy(F.col(column).alias("level")).agg(F.count(F.lit(1)).alias("value"))
    return listed.join(counts, "level", "left").fillna(0, ["value"])


def numeric_histogram(df: DataFrame, value: str, breaks: Sequence[float], how: str = "mean", person: str = "person_id") -> DataFrame:
    """Persons by bin of one clipped value each; the last bin is closed."""
    from .profile import histogram

    reduced = reduce_person(df, value, how, person=person)
    clipped = reduced.withColumn("v", F.greatest(F.least("v", F.lit(float(breaks[-1]))), F.lit(float(breaks[0]))))
    listed = df.sparkSession.createDataFrame([(k,) for k in range(len(breaks) - 1)], "bin long")
    return listed.join(histogram(clipped, "v", breaks, person).select("bin", F.col("n_persons").alias("value")), "bin", "left").fillna(0, ["value"])


def as_number(column: str, kind: str) -> Column:
    """A date as days, or a time (in UTC) as seconds, since 1970."""
    return F.unix_date(F.col(column).cast("date")).cast("double") if kind == "date" else F.unix_timestamp(F.col(column).cast("timestamp")).cast("double")


def break_numbers(breaks: Sequence, kind: str) -> list[float]:
    """Breaks as numbers: numbers as they are, ISO dates as days, ISO times in UTC as seconds since 1970; they must rise."""
    if kind == "date":
        out = [float((dt.date.fromisoformat(b) - dt.date(1970, 1, 1)).days) for b in breaks]
    elif kind == "datetime":
        out = [dt.datetime.fromisoformat(b).replace(tzinfo=dt.timezone.utc).timestamp() for b in breaks]
    else:
        out = [float(b) for b in breaks]
    if len(out) < 2 or any(a >= b for a, b in zip(out, out[1:])):
        raise ValueError("breaks must rise")
    return out


def date_histogram(df: DataFrame, column: str, breaks: Sequence[str], how: str = "min", person: str = "person_id", kind: str = "date") -> DataFrame:
    """Persons by bin of one clipped day (or time) each."""
    return numeric_histogram(df.withColumn("_at", as_number(column, kind)), "_at", break_numbers(breaks, kind), how, person)


def seal(df: DataFrame, key: bytes, recipe: dict, person: str = "person_id") -> str:
    """A proof that a frame is what a person-local recipe made: an HMAC of the recipe and of the content, in whatever order its rows are."""
    if person not in df.columns:
        raise ValueError("a sealed frame needs its persons")
    sums = df.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")), F.lit(0)).alias("h")).first()
    content = {"recipe": recipe, "columns": df.dtypes, "rows": sums["n"], "hash": str(sums["h"])}
    return hmac.new(key, json.dumps(content, sort_keys=True, default=str).encode(), hashlib.sha256).hexdigest()


def verified(df: DataFrame, key: bytes, recipe: dict, proof: str, person: str = "person_id") -> bool:
    """Whether the frame still is what was sealed."""
    return hmac.compare_digest(seal(df, key, recipe, person), proof)


def bounded_distinct(df: DataFrame, column: str, k: int, person: str = "person_id") -> DataFrame:
    """Distinct values over at most k distinct ones a person, the smallest first."""
    w = Window.partitionBy(person).orderBy(column)
    each = df.where(F.col(column).isNotNull()).select(person, column).distinct().withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= k)
    return each.agg(F.countDistinct(column).alias("value"))


def bounded_mean(df: DataFrame, value: str, low: float, high: float, how: str = "mean", person: str = "person_id") -> DataFrame:
    """Persons and the sum of one clipped value each on an integer grid, for half the budget each."""
    grid = F.round((F.greatest(F.least("v", F.lit(high)), F.lit(low)) - low) / (high - low) * GRID)
    return reduce_person(df, value, how, person=person).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(grid), F.lit(0)).cast("long").alias("total"))


def binary_rate(df: DataFrame, value: str, how: str = "any", person: str = "person_id") -> DataFrame:
    """Persons whose reduced flag is 1, of those with one."""
    agg = F.max(value) if how == "any" else F.min(value)
    each = df.where(F.col(value).isNotNull()).groupBy(person).agg(agg.alias("v"))
    return each.agg(F.count(F.when(F.col("v") == 1, 1)).alias("numerator"), F.count(F.lit(1)).alias("denominator"))


def release(frame: DataFrame, key: bytes, query: dict, epsilon: float, columns: Sequence[str], labels: Sequence[str] = (), sensitivity: int | dict[str, int] = 1) -> DataFrame:
    """A bounded aggregate with noise on its value columns; the result has one row a fixed level, so it fits the driver.

    sensitivity: how much one person can change each value column.
    """
    rows = frame.collect()
    most = dict.fromkeys(columns, sensitivity) if isinstance(sensitivity, int) else sensitivity
    out = [tuple(noisy(key, query, f"{c}|" + "|".join(str(r[x]) for x in labels), int(r[c]), epsilon, most[c]) if c in columns else r[c] for c in frame.columns) for r in rows]
    return frame.sparkSession.createDataFrame(out, frame.schema)
