"""Cohorts: (subject_id, cohort_start_date, cohort_end_date) frames, their algebra, criteria and populations."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.cdm import Cdm
from .filters import of_concepts

COHORT = ("subject_id", "cohort_start_date", "cohort_end_date")


@dataclass(frozen=True)
class EventTable:
    """Columns of an event table by role."""

    table: str
    concept: str
    start: str
    end: str | None
    key: str


EVENTS = {
    "condition": EventTable("condition_occurrence", "condition_concept_id", "condition_start_date", "condition_end_date", "condition_occurrence_id"),
    "drug": EventTable("drug_exposure", "drug_concept_id", "drug_exposure_start_date", "drug_exposure_end_date", "drug_exposure_id"),
    "measurement": EventTable("measurement", "measurement_concept_id", "measurement_date", None, "measurement_id"),
    "observation": EventTable("observation", "observation_concept_id", "observation_date", None, "observation_id"),
    "procedure": EventTable("procedure_occurrence", "procedure_concept_id", "procedure_date", None, "procedure_occurrence_id"),
    "visit": EventTable("visit_occurrence", "visit_concept_id", "visit_start_date", "visit_end_date", "visit_occurrence_id"),
}


def events(cdm: Cdm, domain: str, concepts: list[int] | DataFrame | None = None) -> DataFrame:
    """(person_id, concept_id, event_date, event_end, event_key) of a domain."""
    e = EVENTS[domain]
    df = cdm.table(e.table)
    if concepts is not None:
        df = of_concepts(df, e.concept, concepts)
    end = F.coalesce(e.end, e.start) if e.end else F.col(e.start)
    return df.select("person_id", F.col(e.concept).alias("concept_id"), F.col(e.start).alias("event_date"), end.alias("event_end"), F.col(e.key).alias("event_key"))


def from_events(cdm: Cdm, domain: str, concepts: list[int] | DataFrame, value_bin: tuple[float, float] | None = None) -> DataFrame:
    """Distinct episodes from events; the end is the event's, or its start."""
    if value_bin is not None:
        m = of_concepts(cdm.measurement, "measurement_concept_id", concepts).where((F.col("value_as_number") >= value_bin[0]) & (F.col("value_as_number") < value_bin[1]))
        return m.select(F.col("person_id").alias("subject_id"), F.col("measurement_date").alias("cohort_start_date"), F.col("measurement_date").alias("cohort_end_date")).distinct()
    return events(cdm, domain, concepts).select(F.col("person_id").alias("subject_id"), F.col("event_date").alias("cohort_start_date"), F.col("event_end").alias("cohort_end_date")).distinct()


def stored(cdm: Cdm, definition: int) -> DataFrame:
    """A stored cohort's episodes."""
    return cdm.cohort.where(F.col("cohort_definition_id") == definition).select(*COHORT).distinct()


def everyone(cdm: Cdm) -> DataFrame:
    """One row for each observation period."""
    return cdm.observation_period.select(F.col("person_id").alias("subject_id"), F.col("observation_period_start_date").alias("cohort_start_date"), F.col("observation_period_end_date").alias("cohort_end_date")).distinct()


def of_persons(cdm: Cdm, ids: list[int] | DataFrame) -> DataFrame:
    """The observation periods of listed persons."""
    return of_concepts(everyone(cdm), "subject_id", ids)


def intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of a whose person is in b; a's dates stay."""
    return a.join(b.select("subject_id").distinct(), "subject_id", "left_semi")


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    """Distinct rows of both."""
    return a.select(*COHORT).unionByName(b.select(*COHORT)).distinct()


def setdiff(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of a whose person is not in b."""
    return a.join(b.select("subject_id").distinct(), "subject_id", "left_anti")


COMBINE = {"intersect": intersect, "union": union, "setdiff": setdiff}


def combine(op: str, members: list[DataFrame]) -> DataFrame:
    """A left fold; order matters for setdiff."""
    return reduce(COMBINE[op], members)


def numbered(cohort: DataFrame, parts: int | None = None) -> DataFrame:
    """Distinct episodes with cohort_row_id from 1 in order of subject and dates.

    Rows are range-partitioned, counted by partition and numbered within it, so
    no partition holds all of them; only the counts pass through the driver.
    """
    order = list(COHORT)
    spark = cohort.sparkSession
    dealt = cohort.select(*COHORT).distinct()
    dealt = dealt.repartitionByRange(parts, *order) if parts else dealt.repartitionByRange(*order)
    dealt = dealt.withColumn("_part", F.spark_partition_id())
    from ..sources.sinks import staged

    dealt = staged(dealt)
    counts = sorted((r["_part"], r["n"]) for r in dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).collect())
    before, rows = 0, []
    for part, n in counts:
        rows.append((part, before))
        before += n
    offsets = spark.createDataFrame(rows or [(0, 0)], "_part int, _before long")
    within = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return dealt.withColumn("_k", within).join(F.broadcast(offsets), "_part").select(*order, (F.col("_k") + F.col("_before")).alias("cohort_row_id"))


def first_episode(cohort: DataFrame, last: bool = False) -> DataFrame:
    """Each person's first (or last) episode."""
    pick = F.max if last else F.min
    return cohort.groupBy("subject_id").agg(pick(F.struct("cohort_start_date", "cohort_end_date")).alias("e")).select("subject_id", "e.cohort_start_date", "e.cohort_end_date")


@dataclass(frozen=True)
class Criterion:
    """An inclusion rule: occurrences of concepts in days around the index."""

    domain: str
    concepts: tuple[int, ...]
    count: int = 1
    how: str = "at_least"
    window: tuple[int | None, int | None] = (None, None)


def include(cohort: DataFrame, cdm: Cdm, criteria: list[Criterion]) -> DataFrame:
    """Episodes that meet every criterion in turn; none counts as 0."""
    for c in criteria:
        ev = events(cdm, c.domain, list(c.concepts)).select(F.col("person_id").alias("subject_id"), "event_date")
        day = F.datediff("event_date", "cohort_start_date")
        joined = cohort.join(ev, "subject_id")
        for bound, ok in ((c.window[0], day >= F.lit(c.window[0])), (c.window[1], day <= F.lit(c.window[1]))):
            if bound is not None:
                joined = joined.where(ok)
        counted = joined.groupBy(*COHORT).agg(F.count(F.lit(1)).alias("_n"))
        n = F.coalesce("_n", F.lit(0))
        keep = {"at_least": n >= c.count, "at_most": n <= c.count, "exactly": n == c.count}[c.how]
        cohort = cohort.join(counted, list(COHORT), "left").where(keep).drop("_n")
    return cohort


def index_events(cdm: Cdm, domain: str, concepts: list[int], pick: str = "first", days: int | None = None) -> DataFrame:
    """Episodes at events inside exactly one observation period; they end with it, or days later if sooner.

    pick is first, last or all; ties on a day go to the lower key for first and
    to the higher for last.
    """
    ev = events(cdm, domain, concepts)
    op = cdm.observation_period.select("person_id", "observation_period_id", "observation_period_start_date", "observation_period_end_date")
    inside = ev.join(op, "person_id").where("event_date BETWEEN observation_period_start_date AND observation_period_end_date")
    one = inside.groupBy("person_id", "event_date", "event_key").agg(F.count(F.lit(1)).alias("_n"), F.min("observation_period_end_date").alias("period_end")).where("_n = 1").drop("_n")
    if pick != "all":
        order = (F.asc("event_date"), F.asc("event_key")) if pick == "first" else (F.desc("event_date"), F.desc("event_key"))
        one = one.withColumn("_k", F.row_number().over(Window.partitionBy("person_id").orderBy(*order))).where("_k = 1").drop("_k")
    end = F.col("period_end") if days is None else F.least("period_end", F.date_add("event_date", days))
    return one.select(F.col("person_id").alias("subject_id"), F.col("event_date").alias("cohort_start_date"), end.alias("cohort_end_date")).distinct()


# Population filters: each leaf gives (subject_id, cohort_start_date) flags, joined on the episodes.


def _anchored(cohort: DataFrame, cdm: Cdm, leaf: dict) -> DataFrame:
    """Counts of a leaf's events for each episode, within its window of days from the start."""
    ev = events(cdm, leaf["domain"], leaf.get("concepts")).select(F.col("person_id").alias("subject_id"), "event_date")
    joined = cohort.join(ev, "subject_id")
    if window := leaf.get("window"):
        day = F.datediff("event_date", "cohort_start_date")
        joined = joined.where((day >= window[0]) & (day <= window[1]))
    return joined.groupBy(*COHORT).agg(F.count(F.lit(1)).alias("n"))


def flag(cohort: DataFrame, cdm: Cdm, spec: dict) -> DataFrame:
    """cohort with a boolean column ok: the spec's truth for each episode (null: unknown).

    Leaves: sex, age_range, age_group, cohort, has_concept, not_has_concept,
    concept_count, prior_observation, followup, visit_count, has_measurement,
    missing_measurement; groups nest with and / or.
    """
    if "filters" in spec:
        parts = []
        for k, s in enumerate(spec["filters"]):
            cohort = flag(cohort, cdm, s).withColumnRenamed("ok", f"_ok{id(spec)}_{k}")
            parts.append(f"_ok{id(spec)}_{k}")
        both = spec.get("op", "and") == "and"
        ok = reduce((lambda a, b: a & b) if both else (lambda a, b: a | b), map(F.col, parts)) if parts else F.lit(both)
        return cohort.withColumn("ok", ok).drop(*parts)
    kind = spec["type"]
    person = cdm.person.select(F.col("person_id").alias("subject_id"), "gender_concept_id", "year_of_birth")
    age = F.year("cohort_start_date") - F.col("year_of_birth")
    if kind == "sex":
        return cohort.join(person, "subject_id", "left").withColumn("ok", F.col("gender_concept_id") == {"M": 8507, "F": 8532}[spec["value"]]).drop("gender_concept_id", "year_of_birth")
    if kind in ("age_range", "age_group"):
        if kind == "age_range":
            ok = age.between(spec.get("min", 0), spec.get("max", 999))
        else:
            bands = [b[:-1] + "-999" if b.endswith("+") else b for b in spec["value"]]
            ok = reduce(lambda a, b: a | b, [age.between(*map(int, b.split("-"))) for b in bands])
        return cohort.join(person, "subject_id", "left").withColumn("ok", ok).drop("gender_concept_id", "year_of_birth")
    if kind == "cohort":
        return _semi(cohort, stored(cdm, spec["value"]).select("subject_id"), ["subject_id"])
    if kind in ("has_concept", "not_has_concept", "concept_count", "visit_count"):
        leaf = spec if kind != "visit_count" else spec | {"domain": "visit"}
        n = F.coalesce("n", F.lit(0))
        ok = n == 0 if kind == "not_has_concept" else n >= spec.get("min_count", 1)
        return cohort.join(_anchored(cohort, cdm, leaf), list(COHORT), "left").withColumn("ok", ok).drop("n")
    if kind in ("prior_observation", "followup"):
        op = cdm.observation_period.select(F.col("person_id").alias("subject_id"), "observation_period_start_date", "observation_period_end_date")
        good = cohort.join(op, "subject_id").where("cohort_start_date BETWEEN observation_period_start_date AND observation_period_end_date")
        side = F.datediff("cohort_start_date", "observation_period_start_date") if kind == "prior_observation" else F.datediff("observation_period_end_date", "cohort_start_date")
        return _semi(cohort, good.where(side >= spec["days"]).select(*COHORT), list(COHORT))
    m = of_concepts(cdm.measurement, "measurement_concept_id", spec["concepts"]).where("value_as_number IS NOT NULL")
    if value_bin := spec.get("value_bin"):
        m = m.where((F.col("value_as_number") >= value_bin[0]) & (F.col("value_as_number") < value_bin[1]))
    out = _semi(cohort, m.select(F.col("person_id").alias("subject_id")), ["subject_id"])
    return out.withColumn("ok", ~F.col("ok")) if kind == "missing_measurement" else out


def _semi(cohort: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    return cohort.join(keys.distinct().withColumn("_hit", F.lit(True)), on, "left").withColumn("ok", F.coalesce("_hit", F.lit(False))).drop("_hit")


def population(cohort: DataFrame, cdm: Cdm, spec: dict, policy: str = "any_episode") -> DataFrame:
    """Persons of a cohort who satisfy a filter tree, by episode policy.

    any_episode: some episode does; all_episodes: each does, unknown counting as
    failure; first_episode and last_episode: that one does.
    """
    if policy in ("first_episode", "last_episode"):
        cohort = first_episode(cohort, policy == "last_episode")
    ok: Column = F.coalesce(F.col("ok"), F.lit(False)).cast("int")
    marked = flag(cohort, cdm, spec).groupBy("subject_id").agg((F.min(ok) if policy == "all_episodes" else F.max(ok)).alias("_ok"))
    return marked.where("_ok = 1").select("subject_id")
