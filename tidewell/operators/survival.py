"""Risk sets from cohorts and outcomes: survival, competing risks, recurrent events, counting process, multi-state."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.expr import day_diff
from .cohorts import COHORT
from .temporal import observed_once

EPISODE = list(COHORT)


@dataclass(frozen=True)
class Risk:
    """Time at risk in days from the index, washout, and how long observation must have run."""

    start: int = 0
    end: int | None = None
    washout: int = 0
    admin_end: str | None = None


def risk_sets(cohort: DataFrame, periods: DataFrame, death: DataFrame, risk: Risk) -> DataFrame:
    """Eligible episodes with entry and exit.

    Eligible: exactly one observation period covers the index and began at least
    the washout before it; a death, if any, is not before the index.  Exit is
    the earliest of cohort end, observation end, death, end of risk and
    administrative end.
    """
    seen = observed_once(cohort, periods).where(F.datediff("cohort_start_date", "obs_start") >= risk.washout)
    dead = death.groupBy(F.col("person_id").alias("subject_id")).agg(F.min("death_date").alias("death_date"), F.count(F.lit(1)).alias("_d"))
    seen = seen.join(dead, "subject_id", "left").where("coalesce(_d, 0) <= 1 AND (death_date IS NULL OR death_date >= cohort_start_date)")
    ends = [F.col("cohort_end_date"), F.col("obs_end"), F.col("death_date")]
    if risk.end is not None:
        ends.append(F.date_add("cohort_start_date", risk.end))
    if risk.admin_end is not None:
        ends.append(F.lit(risk.admin_end).cast("date"))
    out = seen.withColumn("entry", F.date_add("cohort_start_date", risk.start)).withColumn("exit", F.least(*ends))
    return out.where("exit >= entry").drop("obs_start", "obs_end", "death_date", "_d")


def _outcome_events(sets: DataFrame, events: DataFrame, risk: Risk) -> DataFrame:
    """Distinct outcome days in the risk window, those within the washout of an earlier one dropped."""
    ev = events.select(F.col("person_id").alias("subject_id"), "outcome", "event_date").distinct()
    gap = F.datediff("event_date", F.lag("event_date").over(Window.partitionBy("subject_id", "outcome").orderBy("event_date")))
    if risk.washout:
        ev = ev.withColumn("_gap", gap).where(F.col("_gap").isNull() | (F.col("_gap") > risk.washout)).drop("_gap")
    return sets.join(ev, "subject_id").where("event_date BETWEEN entry AND exit")


def survival(sets: DataFrame, events: DataFrame, outcomes: Sequence[int], risk: Risk, last: bool = False) -> DataFrame:
    """One row for each episode and outcome: the first (or last) event, else censored at exit."""
    hits = _outcome_events(sets, events, risk).groupBy(*EPISODE, "outcome").agg((F.max if last else F.min)("event_date").alias("event_date"))
    grid = sets.withColumn("outcome", F.explode(F.array(*[F.lit(int(o)).cast("long") for o in outcomes])))
    out = grid.join(hits, [*EPISODE, "outcome"], "left")
    return out.select(*EPISODE, "outcome", F.col("event_date").isNotNull().cast("long").alias("status"), day_diff(F.coalesce("event_date", "exit"), F.col("entry")).alias("time"))


def competing_risk(sets: DataFrame, events: DataFrame, outcomes: Sequence[int], risk: Risk, ties: str = "priority") -> DataFrame:
    """The first event over all outcomes; 0 when censored.

    Of outcomes on one day: priority takes the one listed first, all gives a row
    each.
    """
    if ties not in ("priority", "all"):
        raise ValueError(f"ties can't be dealt with by {ties!r}")
    place = F.array_position(F.array(*[F.lit(int(o)).cast("long") for o in outcomes]), F.col("outcome"))
    found = _outcome_events(sets, events, risk).select(*EPISODE, "event_date", place.alias("place"))
    hits = found.groupBy(*EPISODE).agg(F.min(F.struct("event_date", "place")).alias("e")).select(*EPISODE, "e.*")
    if ties == "all":
        hits = found.distinct().join(hits.drop("place"), [*EPISODE, "event_date"])
    out = sets.join(hits, EPISODE, "left")
    return out.select(*EPISODE, F.coalesce("place", F.lit(0)).cast("long").alias("status"), day_diff(F.coalesce("event_date", "exit"), F.col("entry")).alias("time"))


def recurrent(sets: DataFrame, events: DataFrame, risk: Risk) -> DataFrame:
    """All events of each episode, numbered in order, also within their outcome."""
    hits = _outcome_events(sets, events, risk)
    every = Window.partitionBy(*EPISODE).orderBy("event_date", "outcome")
    each = Window.partitionBy(*EPISODE, "outcome").orderBy("event_date")
    return hits.select(*EPISODE, "outcome", day_diff(F.col("event_date"), F.col("entry")).alias("time"), F.row_number().over(every).cast("long").alias("event_number"), F.row_number().over(each).cast("long").alias("outcome_event_number"))


def counting_process(sets: DataFrame, events: DataFrame, risk: Risk) -> DataFrame:
    """(start, stop] intervals for each episode and outcome day, the first from entry - 1, and a tail without event."""
    hits = _outcome_events(sets, events, risk).select(*EPISODE, "entry", "exit", "event_date").distinct()
    w = Window.partitionBy(*EPISODE).orderBy("event_date")
    stop = day_diff(F.col("event_date"), F.col("entry"))
    rows = hits.withColumn("stop", stop).withColumn("start", F.coalesce(F.lag("stop").over(w), F.lit(-1)).cast("long")).select(*EPISODE, "start", "stop", F.lit(1).cast("long").alias("event"))
    last = rows.groupBy(*EPISODE).agg(F.max("stop").alias("_last"))
    tails = sets.join(last, EPISODE, "left").select(*EPISODE, F.coalesce("_last", F.lit(-1)).cast("long").alias("start"), day_diff(F.col("exit"), F.col("entry")).alias("stop"), F.lit(0).cast("long").alias("event")).where("stop > start")
    return rows.unionByName(tails)


def transition_graph(edges: Sequence[tuple[str, str]]) -> tuple[list[str], list[tuple[int, int]]]:
    """States in order of first mention and edges by number from 1; self edges are refused."""
    states: list[str] = []
    for edge in edges:
        if edge[0] == edge[1]:
            raise ValueError("a state can't follow itself")
        states += [s for s in edge if s not in states]
    number = {s: k for k, s in enumerate(states, 1)}
    return states, sorted({(number[a], number[b]) for a, b in edges})


def transition_reference(spark: SparkSession, states: Sequence[str], edges: Sequence[tuple[int, int]]) -> DataFrame:
    """The graph as a table: number and names of each edge."""
    return spark.createDataFrame([(k, a, states[a - 1], b, states[b - 1]) for k, (a, b) in enumerate(edges, 1)], "transition long, from_state long, from_name string, to_state long, to_name string")


def exact_times(rows: DataFrame) -> DataFrame:
    """Times of a multi-state output as decimals of 9 places, as they are exchanged."""
    return rows.withColumns({c: F.col(c).cast("decimal(20,9)") for c in ("start", "stop")})


def multi_state(sets: DataFrame, events: DataFrame, states: Sequence[str], edges: Sequence[tuple[int, int]], first: str) -> DataFrame:
    """One row for each outgoing edge of each state an episode visits; status 1 on the edge taken.

    Events have person_id, state and event_date.  In order of day, then of
    state number, each event moves the episode if the graph has the edge from
    where it is; unreachable ones are skipped.  Events of one day follow each
    other by equal parts of it.
    """
    number = {s: k for k, s in enumerate(states, 1)}
    ways = {s: [b for a, b in edges if a == s] for s in number.values()}
    known = sets.sparkSession.createDataFrame([(s, k) for s, k in number.items()], "state string, state_id long")
    ev = events.join(F.broadcast(known), "state").select(F.col("person_id").alias("subject_id"), "state_id", "event_date").distinct()
    joined = sets.join(ev, "subject_id").where("event_date BETWEEN entry AND exit")
    day = Window.partitionBy(*EPISODE, "event_date")
    part = (F.row_number().over(day.orderBy("state_id")) - 1) / F.count(F.lit(1)).over(day)
    timed = joined.withColumn("at", day_diff(F.col("event_date"), F.col("entry")) + part)
    per = timed.groupBy(*EPISODE).agg(F.array_sort(F.collect_list(F.struct("at", "state_id"))).alias("events"))
    rows = sets.join(per, EPISODE, "left").select(*EPISODE, day_diff(F.col("exit"), F.col("entry")).cast("double").alias("last"), "events")
    edge = "struct<from_state: bigint, to_state: bigint, start: double, stop: double, status: bigint>"
    graph = "map(" + ", ".join(f"{s}L, cast(array({', '.join(f'{b}L' for b in to)}) as array<bigint>)" for s, to in ways.items()) + ")"
    # The state, since when, and the rows so far; a leaving writes a row for every way out.
    walk = f"""aggregate(coalesce(events, cast(array() as array<struct<at: double, state_id: bigint>>)),
        named_struct('state', {number[first]}L, 'since', 0.0D, 'rows', cast(array() as array<{edge}>)),
        (a, e) -> if(array_contains(graph[a.state], e.state_id),
            named_struct('state', e.state_id, 'since', e.at, 'rows', concat(a.rows, transform(graph[a.state], b -> named_struct('from_state', a.state, 'to_state', b, 'start', a.since, 'stop', e.at, 'status', if(b = e.state_id, 1L, 0L))))),
            a),
        a -> if(last > a.since, concat(a.rows, transform(graph[a.state], b -> named_struct('from_state', a.state, 'to_state', b, 'start', a.since, 'stop', last, 'status', 0L))), a.rows))"""
    return rows.withColumn("graph", F.expr(graph)).select(*EPISODE, F.explode(F.expr(walk)).alias("r")).select(*EPISODE, "r.*")
