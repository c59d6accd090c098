"""More population analyses: effects by subgroup, case-series counts and checks, prediction cohorts, pathways and eras."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import day_diff, floor_bin, month_key
from ..operators.cohorts import events, first_episode
from ..sources.cdm import Cdm
from .analyses import covariate_prevalence, fitted_scores, outcome_substrate, standardised_difference
from .standard import distribution

Z = 1.959964


def arm_times(target: DataFrame, comparator: DataFrame, outcome: DataFrame, end: int) -> DataFrame:
    """(subject_id, cohort_start_date, treated, time, event) of both arms' first episodes; time is 1 day at least."""
    parts = []
    for k, arm in ((1, target), (0, comparator)):
        s = outcome_substrate(arm, outcome, 0, end)
        time = F.greatest(F.coalesce("days_to_event", "days"), F.lit(1)).cast("long")
        parts.append(s.select("subject_id", "cohort_start_date", F.lit(k).cast("long").alias("treated"), F.least(time, "days").alias("time"), (F.col("n_events") > 0).cast("long").alias("event")))
    return parts[0].unionByName(parts[1])


def rate_ratio(frame: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Events and days by arm, and the Poisson rate ratio with its Wald interval; null where an arm has no event."""
    on = lambda arm, c: F.coalesce(F.sum(F.when(F.col("treated") == arm, F.col(c))), F.lit(0)).cast("long")
    out = frame.groupBy(*by).agg(*[on(arm, c).alias(f"{n}{arm}") for c, n in (("event", "events"), ("time", "days")) for arm in (1, 0)])
    good = (F.col("events1") > 0) & (F.col("events0") > 0)
    log = F.when(good, F.log(F.col("events1") / F.col("days1")) - F.log(F.col("events0") / F.col("days0")))
    out = out.withColumn("_b", log).withColumn("_se", F.when(good, F.sqrt(1 / F.col("events1") + 1 / F.col("events0"))))
    shown = {"rr": F.exp("_b"), "low": F.exp(F.col("_b") - Z * F.col("_se")), "high": F.exp(F.col("_b") + Z * F.col("_se")), "se": F.col("_se")}
    return out.select(*by, "events1", "days1", "events0", "days0", *[F.round(c, 5).alias(n) for n, c in shown.items()])


def interaction(frame: DataFrame, cdm: Cdm, by: str, cuts: Sequence[int] = (40, 60), concepts: Sequence[int] = ()) -> DataFrame:
    """The rate ratio within each subgroup: by sex, by age between cut points, or by having a condition before the index."""
    if by == "concept":
        had = events(cdm, "condition", list(concepts)).select(F.col("person_id").alias("subject_id"), "event_date").join(frame.select("subject_id", "cohort_start_date").distinct(), "subject_id").where("event_date <= cohort_start_date")
        marked = frame.join(had.select("subject_id", "cohort_start_date").distinct().withColumn("_had", F.lit(1)), ["subject_id", "cohort_start_date"], "left")
        return rate_ratio(marked.withColumn("subgroup", F.when(F.col("_had") == 1, "present").otherwise("absent")), ["subgroup"])
    person = cdm.person.select(F.col("person_id").alias("subject_id"), "gender_concept_id", "year_of_birth")
    age = F.year("cohort_start_date") - F.col("year_of_birth")
    group: Column = F.lit(f"<{cuts[0]}")
    for low in cuts:
        group = F.when(age >= low, F.lit(f"{low}+")).otherwise(group)
    group = F.when(F.col("gender_concept_id") == 8507, "M").when(F.col("gender_concept_id") == 8532, "F") if by == "sex" else group
    return rate_ratio(frame.join(person, "subject_id").withColumn("subgroup", group).where("subgroup IS NOT NULL"), ["subgroup"])


# Self-controlled case series.


def _observed(outcome: DataFrame, cdm: Cdm) -> DataFrame:
    """Distinct outcome days that an observation period covers."""
    ev = outcome.select("subject_id", F.col("cohort_start_date").alias("event_date")).distinct()
    op = cdm.observation_period.select(F.col("person_id").alias("subject_id"), "observation_period_start_date", "observation_period_end_date")
    return ev.join(op, "subject_id").where("event_date BETWEEN observation_period_start_date AND observation_period_end_date").select("subject_id", "event_date").distinct()


def series_attrition(exposure: DataFrame, outcome: DataFrame, cdm: Cdm) -> DataFrame:
    """Cases and events that have the outcome, have it while observed, and have an exposure."""
    steps = (
        ("outcome", outcome.select("subject_id", F.col("cohort_start_date").alias("event_date")).distinct()),
        ("observed", (seen := _observed(outcome, cdm))),
        ("exposed", seen.join(exposure.select("subject_id").distinct(), "subject_id", "left_semi")),
    )
    out = None
    for k, (name, frame) in enumerate(steps):
        row = frame.agg(F.lit(k).cast("long").alias("step"), F.lit(name).alias("rule"), F.countDistinct("subject_id").alias("cases"), F.count(F.lit(1)).alias("events"))
        out = row if out is None else out.unionByName(row)
    return out


def series_histogram(exposure: DataFrame, outcome: DataFrame, cdm: Cdm, width: int = 30) -> DataFrame:
    """Observed events by bin of days from the first exposure, within the exposure or not."""
    first = first_episode(exposure)
    j = _observed(outcome, cdm).join(first, "subject_id")
    offset = F.datediff("event_date", "cohort_start_date")
    inside = F.when(F.col("event_date").between(F.col("cohort_start_date"), F.col("cohort_end_date")), 1).otherwise(0).cast("long")
    return j.groupBy(floor_bin(offset, width).alias("bin"), inside.alias("exposed")).agg(F.count(F.lit(1)).alias("n_events"), F.countDistinct("subject_id").alias("n_subjects"))


def series_checks(exposure: DataFrame, outcome: DataFrame, cdm: Cdm, window: int = 30) -> DataFrame:
    """What a case series assumes: a rare outcome, as many events just before an exposure as just after, and no trend over months."""
    seen = _observed(outcome, cdm)
    observed = cdm.observation_period.agg(F.countDistinct("person_id").alias("n"))
    rare = seen.agg(F.countDistinct("subject_id").alias("cases")).join(F.broadcast(observed), F.lit(True)).select(F.lit("rare_outcome").alias("check"), F.round(F.col("cases") / F.col("n"), 6).alias("value"))
    day = F.datediff("event_date", "cohort_start_date")
    near = seen.join(first_episode(exposure), "subject_id").agg(F.count(F.when(day.between(-window, -1), 1)).alias("b"), F.count(F.when(day.between(1, window), 1)).alias("a"))
    before = near.select(F.lit("pre_exposure_ratio").alias("check"), F.round(F.when(F.col("a") > 0, F.col("b") / F.col("a")), 6).alias("value"))
    monthly = seen.groupBy(month_key(F.col("event_date")).alias("m")).agg(F.count(F.lit(1)).cast("double").alias("n"))
    at = (F.floor(F.col("m") / 100) * 12 + F.col("m") % 100).cast("double")
    trend = monthly.agg(F.regr_slope("n", at).alias("s"), F.avg("n").alias("mean")).select(F.lit("monthly_trend").alias("check"), F.round(F.col("s") / F.col("mean"), 6).alias("value"))
    return rare.unionByName(before).unionByName(trend)


# Prediction.


def eligible(target: DataFrame, cdm: Cdm, look_back: int, start: int, end: int) -> DataFrame:
    """Each person's earliest episode whose whole span, from look-back to the end of risk, lies in one observation period."""
    op = cdm.observation_period.select(F.col("person_id").alias("subject_id"), "observation_period_start_date", "observation_period_end_date")
    low, high = min(0, start, -look_back), max(0, end)
    inside = target.join(op, "subject_id").where((F.col("observation_period_start_date") <= F.date_add("cohort_start_date", low)) & (F.col("observation_period_end_date") >= F.date_add("cohort_start_date", high)))
    return first_episode(inside.select(*target.columns).distinct())


def labelled(cohort: DataFrame, outcome: DataFrame, start: int, end: int) -> DataFrame:
    """cohort with label: an outcome in the days at risk."""
    o = outcome.select("subject_id", F.col("cohort_start_date").alias("o")).join(cohort, "subject_id").where(F.datediff("o", "cohort_start_date").between(start, end))
    return cohort.join(o.select("subject_id").distinct().withColumn("_o", F.lit(1)), "subject_id", "left").withColumn("label", F.coalesce("_o", F.lit(0)).cast("long")).drop("_o")


def prediction_attrition(target: DataFrame, outcome: DataFrame, cdm: Cdm, look_back: int = 365, start: int = 1, end: int = 365) -> DataFrame:
    """Persons, and those with the outcome at risk: of all, those observed throughout, and those of them without it before."""
    whole = eligible(target, cdm, look_back, start, end)
    prior = outcome.select("subject_id", F.col("cohort_start_date").alias("o")).join(whole, "subject_id").where("o < cohort_start_date").select("subject_id").distinct()
    out = None
    for k, (name, frame) in enumerate((("target", first_episode(target)), ("observed", whole), ("no_prior_outcome", whole.join(prior, "subject_id", "left_anti")))):
        row = labelled(frame, outcome, start, end).agg(F.lit(k).cast("long").alias("step"), F.lit(name).alias("rule"), F.count(F.lit(1)).alias("persons"), F.coalesce(F.sum("label"), F.lit(0)).cast("long").alias("outcomes"))
        out = row if out is None else out.unionByName(row)
    return out


def prediction_covariates(target: DataFrame, outcome: DataFrame, ev: DataFrame, cdm: Cdm) -> DataFrame:
    """Persons by prior concept and whether the outcome came at or after the first index, and their share of that group."""
    first = first_episode(target)
    later = outcome.select("subject_id", F.col("cohort_start_date").alias("o")).join(first, "subject_id").where("o >= cohort_start_date").select("subject_id").distinct().withColumn("_o", F.lit(1))
    marked = first.join(later, "subject_id", "left").select("subject_id", "cohort_start_date", F.coalesce("_o", F.lit(0)).cast("long").alias("label"))
    sizes = marked.groupBy("label").agg(F.count(F.lit(1)).alias("size"))
    had = ev.select(F.col("person_id").alias("subject_id"), "concept_id", "event_date").join(marked, "subject_id").where("event_date <= cohort_start_date AND concept_id <> 0")
    counts = had.groupBy("concept_id", "label").agg(F.countDistinct("subject_id").alias("n_subjects"))
    return counts.join(F.broadcast(sizes), "label").select("concept_id", "label", "n_subjects", F.round(F.col("n_subjects") / F.col("size"), 6).alias("share"))


def prediction_diagnostic(target: DataFrame, outcome: DataFrame, ev: DataFrame, cdm: Cdm, look_back: int = 365, start: int = 1, end: int = 365) -> DataFrame:
    """Size, outcomes, incidence, and outcomes for each candidate variable (prior concept)."""
    whole = labelled(eligible(target, cdm, look_back, start, end), outcome, start, end)
    prior = ev.select(F.col("person_id").alias("subject_id"), "concept_id", "event_date").join(whole, "subject_id").where((F.col("concept_id") != 0) & F.datediff("event_date", "cohort_start_date").between(-look_back, 0))
    variables = prior.agg(F.countDistinct("concept_id").alias("variables"))
    size = whole.agg(F.count(F.lit(1)).alias("persons"), F.coalesce(F.sum("label"), F.lit(0)).cast("long").alias("outcomes"))
    out = size.join(F.broadcast(variables), F.lit(True))
    return out.select("persons", "outcomes", "variables", F.round(F.when(F.col("persons") > 0, F.col("outcomes") / F.col("persons")), 6).alias("incidence"), F.round(F.when(F.col("variables") > 0, F.col("outcomes") / F.col("variables")), 6).alias("events_per_variable"))


def prediction_model(target: DataFrame, outcome: DataFrame, ev: DataFrame, cdm: Cdm, look_back: int = 365, start: int = 1, end: int = 365, top: int = 20) -> DataFrame:
    """(subject_id, label, score): predicted risk of the outcome, from the most common concepts of the look-back."""
    whole = labelled(eligible(target, cdm, look_back, start, end), outcome, start, end)
    prior = ev.select(F.col("person_id").alias("subject_id"), "concept_id", "event_date").join(whole, "subject_id").where((F.col("concept_id") != 0) & F.datediff("event_date", "cohort_start_date").between(-look_back, 0))
    return fitted_scores(whole, prior.select("subject_id", "concept_id"), top)


# Pathways and eras.


def duration_eras(target: DataFrame, drugs: DataFrame) -> DataFrame:
    """Days of a drug's records from the index on, one mean a person, as distributions by drug."""
    j = drugs.select(F.col("person_id").alias("subject_id"), "concept_id", "event_date", "event_end").join(first_episode(target), "subject_id").where("event_date >= cohort_start_date")
    each = j.groupBy("concept_id", "subject_id").agg(F.avg(day_diff(F.col("event_end"), F.col("event_date"))).alias("v"))
    return distribution(each, "v", "concept_id")


def gated_pathways(paths: DataFrame, least: int, cap: int = 5) -> DataFrame:
    """(layer, path, n_subjects): nodes of the tree of pathways, depth by depth.

    A node of fewer than least persons joins its small siblings as "Other";
    nothing below it is shown, and "Other" itself goes where it is still too small.
    """
    steps = F.split("path", ">")
    out, kept = None, paths.select(steps.alias("p"), "n_subjects", F.lit("").alias("shown"))
    for layer in range(1, cap + 1):
        reach = kept.where(F.size("p") >= layer).withColumn("step", F.try_element_at("p", F.lit(layer)))
        nodes = reach.groupBy("shown", "step").agg(F.sum("n_subjects").alias("n"))
        name = F.when(F.col("n") >= least, F.col("step")).otherwise(F.lit("Other"))
        path = F.when(F.col("shown") == "", name).otherwise(F.concat("shown", F.lit(">"), name))
        counts = nodes.groupBy(path.alias("path")).agg(F.sum("n").cast("long").alias("n_subjects")).where(F.col("n_subjects") >= least).select(F.lit(layer).cast("long").alias("layer"), "path", "n_subjects")
        out = counts if out is None else out.unionByName(counts)
        shown = nodes.where(F.col("n") >= least).select("shown", "step")
        kept = reach.join(shown, ["shown", "step"]).select("p", "n_subjects", F.when(F.col("shown") == "", F.col("step")).otherwise(F.concat("shown", F.lit(">"), F.col("step"))).alias("shown"))
    return out


# Characterisation.


def age_distribution(target: DataFrame, cdm: Cdm) -> DataFrame:
    """Ages at the first index, from mid-year of birth, in whole years of 365 days."""
    p = first_episode(target).join(cdm.person.select(F.col("person_id").alias("subject_id"), "year_of_birth"), "subject_id")
    age = F.floor(F.datediff("cohort_start_date", F.make_date("year_of_birth", F.lit(7), F.lit(1))) / 365).cast("double")
    return distribution(p.withColumn("v", age), "v")


def temporal_prevalence(target: DataFrame, ev: DataFrame, windows: Sequence[tuple[int, int]]) -> DataFrame:
    """Persons with each concept in each window of days, and their share of the cohort."""
    out = None
    for start, end in windows:
        part = covariate_prevalence(target, ev, start, end).select(F.lit(start).cast("long").alias("start_day"), F.lit(end).cast("long").alias("end_day"), "concept_id", "n_subjects", "share")
        out = part if out is None else out.unionByName(part)
    return out


def temporal_values(target: DataFrame, cdm: Cdm, windows: Sequence[tuple[int, int]]) -> DataFrame:
    """Distributions of measured values by concept and window, one mean a person."""
    m = cdm.measurement.select(F.col("person_id").alias("subject_id"), F.col("measurement_concept_id").alias("concept_id"), "measurement_date", "value_as_number").where("value_as_number IS NOT NULL")
    j = m.join(target, "subject_id").withColumn("day", F.datediff("measurement_date", "cohort_start_date"))
    spans = F.array(*[F.struct(F.lit(a).cast("long").alias("a"), F.lit(b).cast("long").alias("b")) for a, b in windows])
    each = j.withColumn("w", F.explode(spans)).where("day BETWEEN w.a AND w.b").groupBy("concept_id", F.col("w.a").alias("start_day"), "subject_id").agg(F.avg("value_as_number").alias("v"))
    return distribution(each, "v", "concept_id", "start_day")


def risk_factors(target: DataFrame, outcome: DataFrame, ev: DataFrame, end: int = 365) -> DataFrame:
    """Standardised differences by prior concept between persons who get the outcome at risk and those who don't."""
    first = first_episode(target)
    marked = labelled(first, outcome, 1, end)
    sides = [covariate_prevalence(marked.where(F.col("label") == k).drop("label"), ev, -365, 0) for k in (1, 0)]
    return standardised_difference(*sides)


def source_concepts(cdm: Cdm, concepts: DataFrame, domain: str) -> DataFrame:
    """Records and persons of each standard concept of a set, and the source concepts that map to it."""
    maps = cdm.concept_relationship.where("relationship_id = 'Maps to' AND invalid_reason IS NULL").select(F.col("concept_id_2").alias("concept_id"), F.col("concept_id_1").alias("source_concept_id"))
    counts = events(cdm, domain).join(concepts, "concept_id", "left_semi").groupBy("concept_id").agg(F.count(F.lit(1)).alias("n_records"), F.countDistinct("person_id").alias("n_subjects"))
    return counts.join(maps, "concept_id", "left")


def diagnostics(balance: DataFrame, steps: DataFrame, mdrr: float | None, largest: float = 0.1, most: float = 10.0) -> DataFrame:
    """One row: detectable risk, greatest imbalance, share of persons left by attrition, and whether both limits are kept."""
    smd = balance.agg(F.max(F.abs("smd")).alias("max_smd"))
    left = steps.agg(F.max_by("persons", "step").alias("last"), F.min_by("persons", "step").alias("first"))
    out = smd.join(F.broadcast(left), F.lit(True)).select(F.lit(mdrr).cast("double").alias("mdrr"), "max_smd", F.round(F.when(F.col("first") > 0, F.col("last") / F.col("first")), 6).alias("persons_left"))
    return out.withColumn("passed", F.coalesce((F.col("mdrr") <= most) & (F.col("max_smd") <= largest), F.lit(False)))
