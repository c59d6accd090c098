"""Profiling of tables and columns: counts, missingness, prevalence, ranges, histograms, cross-tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expr import month_key, quarter_label
from ..functions.running import values_at
from ..sources.cdm import Cdm
from ..sources.sinks import staged
from .gate import Policy, complementary, gate

#: Levels of an axis of a cross-table.
LEVELS = 1000


def table_stats(df: DataFrame, person: str = "person_id") -> DataFrame:
    """Rows and distinct persons."""
    return df.agg(F.count(F.lit(1)).alias("n_records"), F.countDistinct(person).alias("n_persons"))


def column_stats(df: DataFrame, columns: Sequence[str], person: str = "person_id") -> DataFrame:
    """For each column: rows, missing, distinct values and persons with a value, from one pass."""
    aggs = []
    for c in columns:
        aggs += [F.count(F.when(F.col(c).isNull(), 1)).alias(f"{c}__missing"), F.countDistinct(c).alias(f"{c}__distinct"), F.countDistinct(F.when(F.col(c).isNotNull(), F.col(person))).alias(f"{c}__persons")]
    row = df.agg(F.count(F.lit(1)).alias("_n"), *aggs)
    stack = ", ".join(f"'{c}', `{c}__missing`, `{c}__distinct`, `{c}__persons`" for c in columns)
    return row.selectExpr("_n AS n_total", f"stack({len(columns)}, {stack}) AS (column_name, n_missing, n_distinct, n_persons)")


def person_numeric(df: DataFrame, value: str, person: str = "person_id") -> DataFrame:
    """Mean and standard deviation over one mean a person."""
    means = df.where(F.col(value).isNotNull()).groupBy(person).agg(F.avg(value).alias("v"))
    return means.agg(F.count("v").alias("n_persons"), F.round(F.avg("v"), 6).alias("mean"), F.round(F.stddev_samp("v"), 6).alias("sd"))


def missingness(df: DataFrame, columns: Sequence[str], person: str = "person_id", band: int = 1) -> DataFrame:
    """For each column the persons without any value, and their share of all (of banded counts, 2 places)."""
    has = df.groupBy(person).agg(*[F.max(F.col(c).isNotNull()).alias(c) for c in columns])
    row = has.agg(F.count(F.lit(1)).alias("_n"), *[F.count(F.when(~F.col(c), 1)).alias(c) for c in columns])
    out = row.selectExpr("_n AS n_persons", f"stack({len(columns)}, " + ", ".join(f"'{c}', `{c}`" for c in columns) + ") AS (column_name, n_missing)")
    floor = lambda c: F.floor(F.col(c) / band) * band
    return out.withColumn("missing_rate", F.round(floor("n_missing") / floor("n_persons"), 2))


def value_counts(df: DataFrame, column: str, person: str = "person_id") -> DataFrame:
    """Records and persons by value."""
    return df.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n_records"), F.countDistinct(person).alias("n_persons"))


def prevalence(df: DataFrame, concept: str, policy: Policy, person: str = "person_id", offset: int = 0, limit: int | None = None) -> DataFrame:
    """Persons and records by concept, small cells dropped, counts banded, in banded order."""
    counts = df.groupBy(F.col(concept).alias("concept_id")).agg(F.countDistinct(person).alias("p"), F.count(F.lit(1)).alias("r")).where(F.least("p", "r") >= policy.tab)
    band = lambda c: (F.floor(F.col(c) / policy.band) * policy.band).cast("long")
    out = counts.select("concept_id", band("p").alias("n_persons"), band("r").alias("n_records"))
    if limit is not None:
        out = out.orderBy(F.desc("n_persons"), F.asc_nulls_last("concept_id")).offset(offset).limit(limit)
    return out


def domain_coverage(cdm: Cdm, tables: Sequence[str]) -> DataFrame:
    """Persons by table."""
    parts = [cdm.table(t).agg(F.countDistinct("person_id").alias("n_persons")).withColumn("table_name", F.lit(t)) for t in tables]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def date_counts(df: DataFrame, column: str, unit: str, person: str = "person_id") -> DataFrame:
    """Records and persons by year, quarter or month."""
    label = {"year": F.year(column).cast("string"), "quarter": quarter_label(F.col(column)), "month": F.date_format(column, "yyyy-MM")}[unit]
    return df.where(F.col(column).isNotNull()).groupBy(label.alias("period")).agg(F.count(F.lit(1)).alias("n_records"), F.countDistinct(person).alias("n_persons"))


def offset_quantiles(df: DataFrame, value: str, probabilities: Sequence[float], protect: int, person: str = "person_id") -> DataFrame:
    """Quantiles as values of real rows, at least protect of them from either end, over one mean a person.

    The values at their ranks are found from running counts over ranges of the
    values, so neither one partition nor one aggregate holds them all.  Without
    enough persons no row.
    """
    means = staged(df.where(F.col(value).isNotNull()).groupBy(person).agg(F.avg(value).alias("v")))
    n = means.count()
    schema = ", ".join(f"p{round(100 * p):02d} double" for p in probabilities)
    if n < 2 * protect + 1:
        return df.sparkSession.createDataFrame([], schema)
    found = values_at(means, "v", [min(max(int((n - 1) * p), protect), n - 1 - protect) for p in probabilities])
    return df.sparkSession.createDataFrame([tuple(float(v) for v in found)], schema).select(*[F.round(c.split()[0], 6).alias(c.split()[0]) for c in schema.split(", ")])


def numeric_range(df: DataFrame, value: str, policy: Policy, person: str = "person_id") -> DataFrame:
    """The 5th and 95th percentile over one mean a person; the tails hold enough persons to hide in."""
    return offset_quantiles(df, value, (0.05, 0.95), policy.tab, person)


def drilldown(df: DataFrame, concept: str, concept_id: int, policy: Policy, value: str | None = None, date: str | None = None, category: str | None = None, person: str = "person_id") -> dict[str, DataFrame]:
    """What is known of one concept in a table: summary, and where there are such columns its numbers, dates and categories, gated."""
    rows = df.where(F.col(concept) == concept_id)
    released = lambda frame: gate(frame, "record", ["n_records"], policy, companion="n_persons")
    out = {"summary": released(table_stats(rows, person)), "missingness": missingness(rows, [c for c in rows.columns if c not in (person, concept)], person, policy.band)}
    if value is not None:
        out["numeric"] = person_numeric(rows, value, person).where(F.col("n_persons") >= policy.dist)
    if date is not None:
        out["dates"] = released(date_counts(rows, date, "year", person))
    if category is not None:
        out["categories"] = released(value_counts(rows, category, person))
    return out


def relationship_graph(links: Sequence[tuple[str, str, str]]) -> list[dict]:
    """Edges between tables by the columns that name them."""
    return [{"from": a, "column": c, "to": b} for a, c, b in links]


def histogram(df: DataFrame, value: str, breaks: Sequence[float], person: str = "person_id", minimum: int = 0) -> DataFrame:
    """Records and persons by bin [low, high), the last closed; bins of too few persons are dropped."""
    v, last = F.col(value), len(breaks) - 2
    bin_ = F.lit(None).cast("long")
    for k in range(last, -1, -1):
        inside = (v >= breaks[k]) & ((v < breaks[k + 1]) if k < last else (v <= breaks[k + 1]))
        bin_ = F.when(inside, F.lit(k).cast("long")).otherwise(bin_)
    out = df.withColumn("bin", bin_).where(F.col("bin").isNotNull()).groupBy("bin").agg(F.count(F.lit(1)).alias("n_records"), F.countDistinct(person).alias("n_persons"))
    return out.where(F.col("n_persons") >= minimum)


def equal_breaks(low: float, high: float, bins: int) -> list[float]:
    """Edges of equal-width bins."""
    return [low + (high - low) * k / bins for k in range(bins + 1)]


def safe_cutpoints(df: DataFrame, value: str, grid: Sequence[float], policy: Policy, person: str = "person_id") -> list[float] | None:
    """The public grid's edges, if every bin holds enough persons (one clipped mean each); else None."""
    means = df.where(F.col(value).isNotNull()).groupBy(person).agg(F.greatest(F.least(F.avg(value), F.lit(float(grid[-1]))), F.lit(float(grid[0]))).alias("v"))
    rows = histogram(means, "v", grid, person).collect()
    return list(grid) if len(rows) == len(grid) - 1 and all(r["n_persons"] >= policy.tab for r in rows) else None


def locate(cdm: Cdm, concepts: Sequence[int], columns: Sequence[tuple[str, str]]) -> DataFrame:
    """Records and persons of given concepts in every (table, concept column)."""
    out = None
    for table, column in columns:
        part = cdm.table(table).where(F.col(column).isin(list(concepts))).groupBy(F.col(column).alias("concept_id")).agg(F.count(F.lit(1)).alias("n_records"), F.countDistinct("person_id").alias("n_persons"))
        part = part.select(F.lit(table).alias("table_name"), F.lit(column).alias("column_name"), "concept_id", "n_records", "n_persons")
        out = part if out is None else out.unionByName(part)
    return out


def crosstab(df: DataFrame, row: str, column: str, policy: Policy | None = None, person: str = "person_id", strata: str | None = None) -> DataFrame:
    """Persons by pairs of levels, dense; with a policy small cells and their complements are hidden and the rest banded.

    Each axis has at most LEVELS levels (policy.levels of them with a policy,
    and two at least), which is checked before the dense table is made; with
    strata there is one such table for each of its levels.
    """
    keys = ["row", "col", *(["stratum"] if strata else [])]
    named = [F.col(row).alias("row"), F.col(column).alias("col"), *([F.col(strata).alias("stratum")] if strata else [])]
    counts = staged(df.where(F.col(row).isNotNull() & F.col(column).isNotNull()).groupBy(*named).agg(F.countDistinct(person).alias("n_persons")))
    sizes = counts.agg(*[F.countDistinct(k).alias(k) for k in keys]).first()
    if any(sizes[k] > (policy.levels if policy else LEVELS) for k in keys):
        raise ValueError("too many levels")
    if policy is not None and min(sizes["row"], sizes["col"]) < 2:
        raise ValueError("too few levels")
    dense = counts.select(keys[0]).distinct()
    for k in keys[1:]:  # of at most so many levels each
        dense = dense.join(F.broadcast(counts.select(k).distinct()), F.lit(True))
    dense = dense.join(counts, keys, "left").fillna(0, ["n_persons"])
    if policy is None:
        return dense
    found = dense.collect()
    out = []
    for stratum in sorted({r["stratum"] for r in found}, key=str) if strata else [None]:
        part = [r for r in found if not strata or r["stratum"] == stratum]
        names = sorted({r["row"] for r in part}), sorted({r["col"] for r in part})
        at = {(r["row"], r["col"]): r["n_persons"] for r in part}
        hidden = complementary([[at[r, c] for c in names[1]] for r in names[0]], policy.tab)
        out += [(r, c, *([stratum] if strata else []), None if v is None else v // policy.band * policy.band) for r, line in zip(names[0], hidden) for c, v in zip(names[1], line)]
    return df.sparkSession.createDataFrame(out, dense.schema)


def monthly(df: DataFrame, column: str, person: str = "person_id") -> DataFrame:
    """Records and persons by month as a number."""
    return df.groupBy(month_key(F.col(column)).alias("month")).agg(F.count(F.lit(1)).alias("n_records"), F.countDistinct(person).alias("n_persons"))



def top_values(df: DataFrame, column: str, n: int, policy: Policy, person: str = "person_id") -> DataFrame:
    """The n values of highest banded support, ties by value."""
    counts = value_counts(df, column, person).where(F.col("n_persons") >= policy.tab)
    return counts.orderBy(F.desc(F.floor(F.col("n_persons") / policy.band)), "value").limit(n)
