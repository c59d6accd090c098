"""Running sums, ranks and quantiles over an order of all rows, without one partition that holds them."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.sinks import staged


def with_group_values(df: DataFrame, groups: DataFrame, keys: Sequence[str]) -> DataFrame:
    """df with the other columns of groups, which has one row a group; a null key is a group too.  Without keys there is one group."""
    if not keys:
        return df.join(F.broadcast(groups), F.lit(True))
    other = groups.withColumnsRenamed({k: f"_on_{k}" for k in keys})
    return df.join(other, reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_on_{k}")) for k in keys])).drop(*[f"_on_{k}" for k in keys])


def running_sums(df: DataFrame, order: str, sums: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """df (one row a group of by and value of order) with before_<c> for each c: its sum over the group's rows ahead in order.

    Rows are range-partitioned and summed by partition and group, so that a
    group may lie in many partitions; only those sums are put in order by group.
    """
    by = list(by)
    dealt = staged(df.repartitionByRange(*by, order).withColumn("_part", F.spark_partition_id()))
    ahead = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    within = Window.partitionBy("_part", *by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    parts = dealt.groupBy("_part", *by).agg(*[F.sum(c).alias(c) for c in sums])
    offsets = parts.select("_part", *by, *[F.coalesce(F.sum(c).over(ahead), F.lit(0)).alias(f"_{c}") for c in sums])
    out = dealt.select("*", *[F.coalesce(F.sum(c).over(within), F.lit(0)).alias(f"before_{c}") for c in sums])
    out = with_group_values(out, offsets, ["_part", *by])
    return out.withColumns({f"before_{c}": F.col(f"before_{c}") + F.col(f"_{c}") for c in sums}).drop("_part", *[f"_{c}" for c in sums])


def values_at(df: DataFrame, value: str, ranks: Sequence[int]) -> list[float]:
    """The values at some ranks (from 0) of all rows in order of value."""
    counted = running_sums(df.groupBy(F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("n")), "v", ["n"])
    wanted = df.sparkSession.createDataFrame([(k, int(r)) for k, r in enumerate(ranks)], "k long, rank long")
    hit = counted.join(F.broadcast(wanted), F.expr("rank >= before_n AND rank < before_n + n"))
    return [r["v"] for r in hit.orderBy("k").select("k", "v").collect()]


def summary(df: DataFrame, value: str, quantiles: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """By group: n, mean, sd (of a sample) and interpolated quantiles q0, q1, ... (type 7) of a column; nulls are left out.

    Everything comes from the counts of distinct values and how many rows lie
    below each, in aggregates of fixed size, however many values a group has.
    """
    by = list(by)
    v = F.col("_v")
    counted = df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).cast("double").alias("_v")).agg(F.count(F.lit(1)).alias("n"))
    ranked = running_sums(counted, "_v", ["n"], by)
    totals = ranked.groupBy(*by).agg(F.sum("n").alias("_all"), (F.sum(v * F.col("n")) / F.sum("n")).alias("_mean"))
    rows = with_group_values(ranked, totals, by)

    def at(rank: Column) -> Column:
        return F.max(F.when((F.col("before_n") <= rank) & (rank < F.col("before_n") + F.col("n")), v))

    place = [(F.col("_all") - 1) * q for q in quantiles]
    ends = [c for k, h in enumerate(place) for c in (at(F.floor(h)).alias(f"_low{k}"), at(F.ceil(h)).alias(f"_high{k}"))]
    found = rows.groupBy(*by).agg(F.max("_all").alias("_all"), F.max("_mean").alias("mean"), F.sum(F.col("n") * F.pow(v - F.col("_mean"), 2)).alias("_square"), *ends)
    between = [F.col(f"_low{k}") + (F.col(f"_high{k}") - F.col(f"_low{k}")) * (h - F.floor(h)) for k, h in enumerate(place)]
    return found.select(*by, F.coalesce("_all", F.lit(0)).cast("long").alias("n"), "mean", F.when(F.col("_all") > 1, F.sqrt(F.col("_square") / (F.col("_all") - 1))).alias("sd"), *[c.alias(f"q{k}") for k, c in enumerate(between)])
