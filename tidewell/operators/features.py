"""Feature reducers, wide and sparse covariates, derived person columns and scores."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.expr import concept_label, day_diff
from ..sources.cdm import Cdm

OCCURRENCE = {"boolean", "count", "n_distinct", "abnormal_high", "abnormal_low"}


@dataclass(frozen=True)
class Feature:
    """One output column: a reducer over the events that match concepts, a window of days and a predicate."""

    name: str
    kind: str
    concepts: tuple[int, ...] | None = None
    window: tuple[int, int] | None = None
    where: str | None = None
    reference: str | None = None
    unit: str = "days"
    stat: str = "mean"


def _mask(f: Feature) -> Column:
    m = F.lit(True) if f.concepts is None else F.col("concept_id").isin(list(f.concepts))
    if f.window is not None:
        m = m & F.col("days_from_index").between(*f.window)
    return m & F.expr(f.where) if f.where else m


def _aggregate(f: Feature, m: Column) -> Column:
    """The aggregate of a feature; events have concept_id, event_date, event_end, event_key, value and ranges."""
    on = lambda c: F.when(m, F.col(c) if isinstance(c, str) else c)
    value, n = on("value"), F.count(F.when(m & F.col("value").isNotNull(), 1))
    valued = m & F.col("value").isNotNull()
    days = day_diff(F.col("event_end"), F.col("event_date"))
    mean = F.avg(value)
    stats = {"mean": F.avg, "sum": F.sum, "max": F.max}
    if f.kind == "time_since":
        last = F.max(F.when(m & (F.col("event_date") <= F.lit(f.reference).cast("date")), F.col("event_date")))
        at = F.lit(f.reference).cast("date")
        months = (F.year(at) - F.year(last)) * 12 + F.month(at) - F.month(last) - F.when(F.dayofmonth(at) < F.dayofmonth(last), 1).otherwise(0)
        return day_diff(at, last) if f.unit == "days" else months.cast("long")
    return {
        "boolean": lambda: F.max(F.when(m, 1).otherwise(0)).cast("long"),
        "count": lambda: F.count(F.when(m, 1)),
        "n_distinct": lambda: F.countDistinct(on("concept_id")),
        "mean_value": lambda: mean,
        "min_value": lambda: F.min(value),
        "max_value": lambda: F.max(value),
        "sum_value": lambda: F.sum(value),
        "first_value": lambda: F.min_by("value", F.when(valued, F.struct("event_date", "event_key"))),
        "latest_value": lambda: F.max_by("value", F.when(valued, F.struct("event_date", (-F.col("event_key")).alias("k")))),
        "sd_value": lambda: F.when(n >= 2, F.stddev_samp(value)),
        "cv_value": lambda: F.when((n >= 2) & (mean != 0), 100 * F.stddev_samp(value) / mean),
        "slope_value": lambda: F.when(F.countDistinct(F.when(valued, F.col("event_date"))) >= 2, F.regr_slope(value, on(F.unix_date("event_date").cast("double")))),
        "abnormal_high": lambda: F.count(F.when(m & (F.col("value") > F.col("range_high")), 1)),
        "abnormal_low": lambda: F.count(F.when(m & (F.col("value") < F.col("range_low")), 1)),
        "drug_duration": lambda: stats[f.stat](on(days)),
        "duration_sum": lambda: F.sum(on(days)),
        "gap_max_days": lambda: F.max(F.when(m, F.col(f"_gap_{f.name}"))),
        "gap_mean_days": lambda: F.avg(F.when(m, F.col(f"_gap_{f.name}"))),
    }[f.kind]()


def features(events: DataFrame, roster: DataFrame, specs: Sequence[Feature], keys: Sequence[str] = ("person_id",)) -> DataFrame:
    """One row for each roster key and one column for each feature, from one aggregation.

    Occurrence features are 0 without events; value features are null.
    """
    keys = list(keys)
    for f in specs:
        if f.kind.startswith("gap_"):
            w = Window.partitionBy(*keys, _mask(f)).orderBy("event_date", "event_key")
            events = events.withColumn(f"_gap_{f.name}", F.datediff("event_date", F.lag("event_date").over(w)).cast("long"))
    out = events.groupBy(*keys).agg(*[_aggregate(f, _mask(f)).alias(f.name) for f in specs])
    out = roster.select(*keys).distinct().join(out, keys, "left")
    return out.fillna(0, [f.name for f in specs if f.kind in OCCURRENCE])


def auto_features(events: DataFrame, keys: Sequence[str] = ("person_id",)) -> DataFrame:
    """Presence, count, mean, minimum and maximum for each key and observed concept, long."""
    return events.groupBy(*keys, "concept_id").agg(F.lit(1).cast("long").alias("present"), F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"), F.min("value").alias("min"), F.max("value").alias("max"))


def wide(events: DataFrame, roster: DataFrame, concepts: dict[int, str], value: str = "value", keys: Sequence[str] = ("person_id",)) -> DataFrame:
    """One row a roster key, one column for each listed concept, absent ones too.

    The list of concepts is closed, so the pivot needs no pass to find them;
    more than one record of a key and concept is an error at run time.
    """
    keys = list(keys)
    once = F.when(F.count(value) > 1, F.raise_error(F.lit("more than one record of a concept"))).otherwise(F.first(value, ignorenulls=True))
    out = events.where(F.col("concept_id").isin(list(concepts))).groupBy(*keys).pivot("concept_id", list(concepts)).agg(once)
    out = out.select(*keys, *[F.col(f"`{c}`").alias(n) for c, n in concepts.items()])
    return roster.select(*keys).distinct().join(out, keys, "left")


#: Suffix of a covariate id by what it measures.
SPARSE = {"present": 1, "n": 2, "mean": 3, "min": 4, "max": 5}


def sparse(events: DataFrame, keys: Sequence[str] = ("person_id",)) -> tuple[DataFrame, DataFrame]:
    """Triplets (keys, covariate_id, value) with covariate_id = concept * 1000 + measure, and the reference of covariates."""
    long = auto_features(events, keys)
    pairs = ", ".join(f"{code}, CAST({column} AS DOUBLE)" for column, code in SPARSE.items())
    triplets = long.selectExpr(*keys, "concept_id", f"stack({len(SPARSE)}, {pairs}) AS (measure, value)").where("value IS NOT NULL").select(*keys, (F.col("concept_id") * 1000 + F.col("measure")).alias("covariate_id"), "value")
    reference = triplets.select("covariate_id").distinct().withColumn("concept_id", F.floor(F.col("covariate_id") / 1000).cast("long"))
    return triplets, reference


def dictionary(cdm: Cdm, ids: DataFrame) -> DataFrame:
    """Names and safe column labels of the concepts in an output."""
    c = cdm.concept.select("concept_id", "concept_name")
    return ids.select("concept_id").distinct().join(c, "concept_id").withColumn("label", concept_label(F.col("concept_name")))


def declared_dictionary(spark: SparkSession, concepts: dict[int, str]) -> DataFrame:
    """The dictionary of an output whose concepts are declared, without a look at the vocabulary."""
    return spark.createDataFrame([(int(c), n) for c, n in concepts.items()], "concept_id long, concept_name string").withColumn("label", concept_label(F.col("concept_name")))


def derived(cdm: Cdm, reference: str) -> DataFrame:
    """Per person: age, sex, observed days (total, first, last, longest), days before and after a date, missing demographics."""
    at = F.lit(reference).cast("date")
    days = day_diff(F.col("observation_period_end_date"), F.col("observation_period_start_date"))
    op = cdm.observation_period.withColumn("days", days)
    total = op.groupBy("person_id").agg(F.sum("days").alias("obs_total"), F.min_by("days", "observation_period_start_date").alias("obs_first"), F.max_by("days", "observation_period_start_date").alias("obs_last"), F.max("days").alias("obs_longest"))
    around = op.where(at.between(F.col("observation_period_start_date"), F.col("observation_period_end_date"))).groupBy("person_id").agg(F.max(day_diff(at, F.col("observation_period_start_date"))).alias("prior_obs"), F.max(day_diff(F.col("observation_period_end_date"), at)).alias("followup"))
    age = F.year(at) - F.col("year_of_birth")
    missing = sum(F.when(F.coalesce(F.col(c), F.lit(0)) == 0, 1).otherwise(0) for c in ("gender_concept_id", "race_concept_id", "ethnicity_concept_id"))
    sex = F.when(F.col("gender_concept_id") == 8507, "M").when(F.col("gender_concept_id") == 8532, "F")
    out = cdm.person.select("person_id", F.when(age >= 0, age).cast("long").alias("age"), sex.alias("sex_mf"), missing.cast("long").alias("demo_missingness"))
    return out.join(total, "person_id", "left").join(around, "person_id", "left")


@dataclass(frozen=True)
class Score:
    """Weights by category, and the concepts (with their descendants) of each category."""

    categories: dict[str, tuple[float, tuple[int, ...]]]
    ages: tuple[tuple[int, float], ...] = ()
    female: float = 0.0


def score(cdm: Cdm, spec: Score, reference_year: int) -> DataFrame:
    """Per person the weights of the categories present, each once, plus points for age and sex.

    Of the age steps the highest reached counts.
    """
    rows = [(c, name, float(w)) for name, (w, concepts) in spec.categories.items() for c in concepts]
    seeds = cdm.spark.createDataFrame(rows, "ancestor_concept_id long, category string, weight double")
    below = cdm.concept_ancestor.join(F.broadcast(seeds), "ancestor_concept_id").select(F.col("descendant_concept_id").alias("condition_concept_id"), "category", "weight")
    hits = cdm.condition_occurrence.select("person_id", "condition_concept_id").distinct().join(below, "condition_concept_id")
    points = hits.groupBy("person_id", "category").agg(F.max("weight").alias("w")).groupBy("person_id").agg(F.sum("w").alias("_points"))
    age = F.lit(reference_year) - F.col("year_of_birth")
    by_age = F.lit(0.0)
    for low, weight in sorted(spec.ages):
        by_age = F.when(age >= low, F.lit(float(weight))).otherwise(by_age)
    sex = F.when(F.col("gender_concept_id") == 8532, F.lit(float(spec.female))).otherwise(0.0)
    return cdm.person.join(points, "person_id", "left").select("person_id", (F.coalesce("_points", F.lit(0.0)) + by_age + sex).alias("score"))


def code_patterns(cdm: Cdm, patterns: Sequence[str]) -> DataFrame:
    """Standard concepts that source concepts with names like the patterns map to."""
    like = F.lit(False)
    for p in patterns:
        like = like | F.lower("concept_name").like(p.lower())
    source = cdm.concept.where(like).select(F.col("concept_id").alias("concept_id_1"))
    r = cdm.concept_relationship.where("relationship_id = 'Maps to' AND invalid_reason IS NULL")
    return r.join(source, "concept_id_1", "left_semi").select(F.col("concept_id_2").alias("concept_id")).distinct()
