"""Time-anchored row operators: index windows, event selection, gap chains, bins, panels and intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .cohorts import COHORT


MAX_BINS = 10_000


def check_bins(start: int, end: int, width: int) -> int:
    """How many bins of a width days start to end have; raises unless the spec makes sense."""
    if end < start or width < 1:
        raise ValueError("days must run forward, in bins of a day or more")
    bins = (end - start) // width + 1
    if bins > MAX_BINS:
        raise ValueError(f"at most {MAX_BINS} bins")
    return bins


def check_spec(spec: dict) -> None:
    """Raises unless a temporal spec holds known parts: index_window, calendar, event_select, min_gap."""
    if unknown := set(spec) - {"index_window", "calendar", "event_select", "min_gap"}:
        raise ValueError(f"unknown temporal part {sorted(unknown)[0]!r}")
    if "index_window" in spec and spec["index_window"][0] is not None and spec["index_window"][1] is not None and spec["index_window"][0] > spec["index_window"][1]:
        raise ValueError("the window ends before it starts")
    if "event_select" in spec and (spec["event_select"].get("order") not in ("first", "last") or spec["event_select"].get("n", 1) < 1):
        raise ValueError("events are selected as first or last, one at least")
    if "min_gap" in spec and spec["min_gap"] < 1:
        raise ValueError("a gap is a day at least")


def by_spec(events: DataFrame, cohort: DataFrame, spec: dict) -> DataFrame:
    """Events by a temporal spec, its parts in order: window around the index, calendar, gaps, selection by person."""
    check_spec(spec)
    out = index_window(events, cohort, *spec.get("index_window", (None, None)))
    low, high = spec.get("calendar", (None, None))
    out = out.where(F.col("event_date") >= F.lit(low).cast("date")) if low else out
    out = out.where(F.col("event_date") <= F.lit(high).cast("date")) if high else out
    if "min_gap" in spec:
        out = min_gap(out, ["person_id", "concept_id"], spec["min_gap"])
    if "event_select" in spec:
        out = event_select(out, ["person_id"], spec["event_select"].get("n", 1), spec["event_select"]["order"] == "last")
    return out


def index_window(events: DataFrame, cohort: DataFrame, start: int | None = None, end: int | None = None) -> DataFrame:
    """Events joined to their person's episodes, with days_from_index, within [start, end] days."""
    c = cohort.select(F.col("subject_id").alias("person_id"), "cohort_start_date", "cohort_end_date")
    out = events.join(c, "person_id").withColumn("days_from_index", F.datediff("event_date", "cohort_start_date").cast("long"))
    if start is not None:
        out = out.where(F.col("days_from_index") >= start)
    if end is not None:
        out = out.where(F.col("days_from_index") <= end)
    return out


def event_select(events: DataFrame, by: list[str], n: int = 1, last: bool = False) -> DataFrame:
    """The first or last n events of each group; ties on a day go to the lower key either way."""
    order = (F.desc("event_date") if last else F.asc("event_date"), F.asc("event_key"))
    return events.withColumn("_k", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_k") <= n).drop("_k")


def min_gap(events: DataFrame, by: list[str], days: int, last: bool = False) -> DataFrame:
    """One event (first or last) of each chain of events at most days apart."""
    w = Window.partitionBy(*by).orderBy("event_date", "event_key")
    gap = F.datediff("event_date", F.lag("event_date").over(w))
    chained = events.withColumn("_new", F.when(gap <= days, 0).otherwise(1)).withColumn("_chain", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    order = (F.desc("event_date"), F.desc("event_key")) if last else (F.asc("event_date"), F.asc("event_key"))
    picked = F.row_number().over(Window.partitionBy(*by, "_chain").orderBy(*order))
    return chained.withColumn("_k", picked).where("_k = 1").drop("_k", "_chain", "_new")


def handle_dates(df: DataFrame, how: str = "remove", index: str | None = None, unit: str = "month") -> DataFrame:
    """Dates removed, made relative to an index date, or binned to text; absolute leaves them."""
    dates = [f.name for f in df.schema.fields if f.dataType.typeName() in ("date", "timestamp", "timestamp_ntz")]
    if how == "remove":
        return df.drop(*dates)
    if how == "relative":
        return df.select(*[F.datediff(c, index).cast("long").alias(c) if c in dates else F.col(c) for c in df.columns])
    if how == "binned":
        form = {"year": "yyyy", "month": "yyyy-MM", "week": "yyyy-MM-dd"}[unit]
        return df.select(*[F.date_format(F.date_trunc(unit, c), form).alias(c) if c in dates else F.col(c) for c in df.columns])
    if how == "absolute":
        return df
    raise ValueError(f"unknown date handling {how!r}")


def observed_once(episodes: DataFrame, periods: DataFrame) -> DataFrame:
    """Episodes whose start lies in exactly one observation period, with its bounds."""
    op = periods.select(F.col("person_id").alias("subject_id"), F.col("observation_period_start_date").alias("obs_start"), F.col("observation_period_end_date").alias("obs_end"))
    inside = episodes.join(op, "subject_id").where("cohort_start_date BETWEEN obs_start AND obs_end")
    return inside.groupBy(*COHORT).agg(F.count(F.lit(1)).alias("_n"), F.min("obs_start").alias("obs_start"), F.max("obs_end").alias("obs_end")).where("_n = 1").drop("_n")


def roster(episodes: DataFrame, periods: DataFrame) -> DataFrame:
    """observed_once(), where every episode must have its one observation period."""
    found = observed_once(episodes, periods)
    if episodes.select(*COHORT).distinct().count() != found.count():
        raise ValueError("an episode starts in no observation period, or in several")
    return found


def temporal_covariates(events: DataFrame, cohort: DataFrame, periods: DataFrame, start: int, end: int, width: int) -> DataFrame:
    """(episode, concept_id, bin, binary, count): events by bin of days from the index, while observed.

    Bins are numbered from 1: floor((day - start) / width) + 1.
    """
    check_bins(start, end, width)
    episodes = observed_once(cohort, periods)
    joined = events.select(F.col("person_id").alias("subject_id"), "concept_id", "event_date").join(episodes, "subject_id")
    day = F.datediff("event_date", "cohort_start_date")
    joined = joined.where("event_date BETWEEN obs_start AND obs_end").where((day >= start) & (day <= end))
    bin_ = (F.floor((day - start) / width) + 1).cast("long")
    return joined.groupBy(*COHORT, "concept_id", bin_.alias("bin")).agg(F.lit(1).cast("long").alias("present"), F.count(F.lit(1)).alias("n_records"))


def person_period(cohort: DataFrame, periods: DataFrame, start: int, end: int, width: int) -> DataFrame:
    """One row for each episode and bin that observation reaches, clipped, with days observed (both ends count)."""
    episodes = observed_once(cohort, periods)
    n = check_bins(start, end, width)
    grid = episodes.withColumn("bin", F.explode(F.sequence(F.lit(1), F.lit(n)))).withColumn("bin", F.col("bin").cast("long"))
    low = F.expr(f"date_add(cohort_start_date, CAST({start} + (bin - 1) * {width} AS INT))")
    high = F.expr(f"date_add(cohort_start_date, CAST(least({start} + bin * {width} - 1, {end}) AS INT))")
    out = grid.withColumn("bin_start", F.greatest(low, "obs_start")).withColumn("bin_end", F.least(high, "obs_end")).where("bin_start <= bin_end")
    return out.withColumn("days_observed", (F.datediff("bin_end", "bin_start") + 1).cast("long")).drop("obs_start", "obs_end")


#: How an interval [event_date, event_end] lies to a window [low, high].
RELATIONS = {
    "overlaps": "event_date <= high AND event_end >= low",
    "starts_in": "event_date BETWEEN low AND high",
    "ends_in": "event_end BETWEEN low AND high",
    "active_at": "event_date <= low AND event_end >= low",
}


def intervals(events: DataFrame, cohort: DataFrame, relation: str = "overlaps", window: tuple[int, int] | None = None, pick: str = "all", n: int = 1) -> DataFrame:
    """Events whose interval relates to each episode (or to a window of days around its start).

    pick is all, first, last (ties to the higher key) or nearest in days to the
    episode's start (ties to the earlier, then to the lower key).
    """
    c = cohort.select(F.col("subject_id").alias("person_id"), "cohort_start_date", "cohort_end_date")
    c = c.withColumn("low", F.col("cohort_start_date") if window is None else F.date_add("cohort_start_date", window[0]))
    c = c.withColumn("high", F.col("cohort_end_date") if window is None else F.date_add("cohort_start_date", window[1]))
    out = events.join(c, "person_id").where(RELATIONS[relation]).drop("low", "high")
    if pick == "all":
        return out
    distance = F.abs(F.datediff("event_date", "cohort_start_date"))
    order = {"first": [F.asc("event_date"), F.asc("event_key")], "last": [F.desc("event_date"), F.desc("event_key")], "nearest": [distance.asc(), F.asc("event_date"), F.asc("event_key")]}[pick]
    w = Window.partitionBy("person_id", "cohort_start_date", "cohort_end_date").orderBy(*order)
    return out.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= n).drop("_k")


def last_before(events: DataFrame, anchors: DataFrame, on: str = "person_id", at: str = "anchor_date") -> DataFrame:
    """For each anchor the latest event at or before it (as-of join); anchors without one have nulls."""
    keys = anchors.columns
    hits = anchors.join(events.select(on, "event_date", "event_key"), on).where(F.col("event_date") <= F.col(at))
    best = hits.groupBy(*keys).agg(F.max(F.struct("event_date", (-F.col("event_key")).alias("k"))).alias("e"))
    return anchors.join(best, keys, "left").select(*keys, F.col("e.event_date").alias("event_date"), (-F.col("e.k")).alias("event_key"))
