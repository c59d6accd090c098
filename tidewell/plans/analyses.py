"""Population analyses over cohorts: incidence, characterisation, comparison, case series, prediction, pathways."""

from __future__ import annotations

import math
from collections.abc import Sequence
from statistics import NormalDist

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import day_diff, floor_bin, month_key
from ..functions.running import running_sums, summary
from ..operators.cohorts import events, first_episode
from ..sources.cdm import Cdm
from ..sources.sinks import staged
from .standard import distribution


def outcome_substrate(target: DataFrame, outcome: DataFrame, start: int, end: int | None) -> DataFrame:
    """One row a person's first episode: days at risk, outcomes in it, and days to the first.

    Outcomes are aggregated before the join back, so days at risk never fan out.
    """
    first = first_episode(target)
    stop = F.col("cohort_end_date") if end is None else F.least("cohort_end_date", F.date_add("cohort_start_date", end))
    at_risk = first.withColumn("risk_start", F.date_add("cohort_start_date", start)).withColumn("risk_end", stop).where("risk_end >= risk_start")
    o = outcome.select("subject_id", F.col("cohort_start_date").alias("event_date")).distinct()
    hits = at_risk.join(o, "subject_id").where("event_date BETWEEN risk_start AND risk_end").groupBy("subject_id").agg(F.count(F.lit(1)).alias("n_events"), F.min("event_date").alias("first_event"))
    out = at_risk.join(hits, "subject_id", "left")
    return out.select("subject_id", "cohort_start_date", (day_diff(F.col("risk_end"), F.col("risk_start")) + 1).alias("days"), F.coalesce("n_events", F.lit(0)).alias("n_events"), day_diff(F.col("first_event"), F.col("risk_start")).alias("days_to_event"))


def incidence_rate(target: DataFrame, outcome: DataFrame, cdm: Cdm, start: int = 0, end: int | None = None, strata: Sequence[str] = ()) -> DataFrame:
    """Persons, days at risk, outcomes and persons with one; proportion, and rate per 1000 years; by sex, age band or year."""
    s = outcome_substrate(target, outcome, start, end).join(cdm.person.select(F.col("person_id").alias("subject_id"), "gender_concept_id", "year_of_birth"), "subject_id")
    named = {"gender": F.col("gender_concept_id"), "age_band": floor_bin(F.year("cohort_start_date") - F.col("year_of_birth"), 10), "year": F.year("cohort_start_date").cast("long")}
    out = s.groupBy(*[named[x].alias(x) for x in strata]).agg(F.count(F.lit(1)).alias("n_persons"), F.sum("days").alias("person_days"), F.sum("n_events").alias("n_outcomes"), F.count(F.when(F.col("n_events") > 0, 1)).alias("n_with_outcome"))
    return out.withColumn("proportion", F.round(F.col("n_with_outcome") / F.col("n_persons"), 6)).withColumn("rate", F.round(F.col("n_outcomes") / (F.col("person_days") / 365.25) * 1000, 6))


def index_breakdown(target: DataFrame, cdm: Cdm, domain: str) -> DataFrame:
    """Concepts recorded on the index date."""
    ev = events(cdm, domain).select(F.col("person_id").alias("subject_id"), "concept_id", F.col("event_date").alias("cohort_start_date"))
    return target.join(ev, ["subject_id", "cohort_start_date"]).groupBy("concept_id").agg(F.count(F.lit(1)).alias("n_events"), F.countDistinct("subject_id").alias("n_subjects"))


def time_distribution(target: DataFrame, cdm: Cdm) -> DataFrame:
    """Prior observation, follow-up and time in cohort, as distributions over persons' means."""
    op = cdm.observation_period.select(F.col("person_id").alias("subject_id"), "observation_period_start_date", "observation_period_end_date")
    inside = target.join(op, "subject_id").where("cohort_start_date BETWEEN observation_period_start_date AND observation_period_end_date")
    measures = inside.select("subject_id", F.expr("stack(3, 'prior_observation', CAST(datediff(cohort_start_date, observation_period_start_date) AS BIGINT), 'follow_up', CAST(datediff(observation_period_end_date, cohort_start_date) AS BIGINT), 'time_in_cohort', CAST(datediff(cohort_end_date, cohort_start_date) AS BIGINT)) AS (measure, days)"))
    return distribution(measures.groupBy("measure", "subject_id").agg(F.avg("days").alias("v")), "v", "measure")


def time_to_event(target: DataFrame, ev: DataFrame, width: int, low: int, high: int, cap: int) -> DataFrame:
    """Events by bin of days from the index; a person counts at most cap times a bin."""
    joined = target.join(ev.select(F.col("person_id").alias("subject_id"), "event_date"), "subject_id").withColumn("day", F.datediff("event_date", "cohort_start_date")).where(F.col("day").between(low, high))
    per = joined.groupBy("subject_id", floor_bin(F.col("day"), width).alias("bin")).agg(F.least(F.count(F.lit(1)), F.lit(cap)).alias("n"))
    return per.groupBy("bin").agg(F.sum("n").cast("long").alias("n_events"), F.count(F.lit(1)).alias("n_subjects"))


def visit_context(target: DataFrame, cdm: Cdm) -> DataFrame:
    """Persons by kind of visit and where it lies to the index: before, after, on its first day, or around it."""
    v = cdm.visit_occurrence.select(F.col("person_id").alias("subject_id"), "visit_concept_id", "visit_start_date", "visit_end_date")
    place = F.when(F.col("visit_end_date") < F.col("cohort_start_date"), "before").when(F.col("visit_start_date") > F.col("cohort_start_date"), "after").when(F.col("visit_start_date") == F.col("cohort_start_date"), "on").otherwise("during")
    return target.join(v, "subject_id").groupBy("visit_concept_id", place.alias("position")).agg(F.countDistinct("subject_id").alias("n_subjects"))


def covariate_prevalence(target: DataFrame, ev: DataFrame, start: int, end: int) -> DataFrame:
    """Persons with each concept in days around the index, and their share of the cohort."""
    joined = ev.select(F.col("person_id").alias("subject_id"), "concept_id", "event_date").join(target, "subject_id").where(F.datediff("event_date", "cohort_start_date").between(start, end))
    size = target.agg(F.countDistinct("subject_id").alias("n_cohort"))
    counts = joined.where("concept_id <> 0").groupBy("concept_id").agg(F.countDistinct("subject_id").alias("n_subjects"))
    return counts.join(F.broadcast(size), F.lit(True)).withColumn("share", F.round(F.col("n_subjects") / F.col("n_cohort"), 6)).drop("n_cohort")


def covariate_values(target: DataFrame, cdm: Cdm, start: int, end: int) -> DataFrame:
    """Distributions of measured values by concept, one mean a person."""
    m = cdm.measurement.select(F.col("person_id").alias("subject_id"), F.col("measurement_concept_id").alias("concept_id"), "measurement_date", "value_as_number").where("value_as_number IS NOT NULL")
    joined = m.join(target, "subject_id").where(F.datediff("measurement_date", "cohort_start_date").between(start, end))
    return distribution(joined.groupBy("concept_id", "subject_id").agg(F.avg("value_as_number").alias("v")), "v", "concept_id")


def demographics(target: DataFrame, cdm: Cdm) -> DataFrame:
    """Persons by sex, race, ethnicity and ten-year age at first index."""
    p = first_episode(target).join(cdm.person.withColumnRenamed("person_id", "subject_id"), "subject_id")
    age = floor_bin(F.year("cohort_start_date") - F.col("year_of_birth"), 10)
    parts = [p.groupBy(F.lit(kind).alias("kind"), c.cast("long").alias("level")).agg(F.countDistinct("subject_id").alias("n_subjects")) for kind, c in (("gender", F.col("gender_concept_id")), ("race", F.col("race_concept_id")), ("ethnicity", F.col("ethnicity_concept_id")), ("age", age))]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def table1(target: DataFrame, cdm: Cdm, ev: DataFrame) -> DataFrame:
    """Demographics and covariate prevalence in one frame."""
    covariates = covariate_prevalence(target, ev, -365, 0).select(F.lit("concept").alias("kind"), F.col("concept_id").alias("level"), "n_subjects")
    return demographics(target, cdm).unionByName(covariates)


def standardised_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """SMD by concept of two prevalence frames (concept_id, n_subjects, share); absent is 0."""
    left, right = a.select("concept_id", F.col("share").alias("p1")), b.select("concept_id", F.col("share").alias("p2"))
    both = left.join(right, "concept_id", "full").fillna(0.0, ["p1", "p2"])
    spread = F.sqrt((F.col("p1") * (1 - F.col("p1")) + F.col("p2") * (1 - F.col("p2"))) / 2)
    return both.withColumn("smd", F.when(spread > 0, F.round((F.col("p1") - F.col("p2")) / spread, 5)))


def overlap(a: DataFrame, b: DataFrame) -> DataFrame:
    """Persons in both, in one only, in either."""
    x, y = a.select("subject_id").distinct().withColumn("a", F.lit(1)), b.select("subject_id").distinct().withColumn("b", F.lit(1))
    j = x.join(y, "subject_id", "full")
    return j.agg(F.count(F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), 1)).alias("both"), F.count(F.when(F.col("b").isNull(), 1)).alias("a_only"), F.count(F.when(F.col("a").isNull(), 1)).alias("b_only"), F.count(F.lit(1)).alias("either"))


def cohort_count(target: DataFrame) -> DataFrame:
    """Entries and subjects."""
    return target.agg(F.count(F.lit(1)).alias("entries"), F.countDistinct("subject_id").alias("subjects"))


def time_series(target: DataFrame) -> DataFrame:
    """Subjects, records and days by year of start."""
    return target.groupBy(F.year("cohort_start_date").cast("long").alias("year")).agg(F.countDistinct("subject_id").alias("subjects"), F.count(F.lit(1)).alias("records"), F.sum(day_diff(F.col("cohort_end_date"), F.col("cohort_start_date")) + 1).alias("person_days"))


def two_arms(a: DataFrame, b: DataFrame) -> tuple[DataFrame, DataFrame]:
    """First treatment wins: each arm's first episodes, cut a day before the other's start; same-day starters leave both."""
    x, y = first_episode(a), first_episode(b)

    def arm(own: DataFrame, other: DataFrame) -> DataFrame:
        o = other.select("subject_id", F.col("cohort_start_date").alias("other"))
        j = own.join(o, "subject_id", "left").where("other IS NULL OR other > cohort_start_date")
        return j.select("subject_id", "cohort_start_date", F.least("cohort_end_date", F.date_sub("other", 1)).alias("cohort_end_date"))

    return arm(x, y), arm(y, x)


def attrition(target: DataFrame, cdm: Cdm, require: list[int], exclude: list[int], age: tuple[int, int], prior_days: int) -> DataFrame:
    """Persons and exposures left after each rule in turn, from one pass over cumulative flags."""
    has = lambda concepts: events(cdm, "condition", concepts).select(F.col("person_id").alias("subject_id")).distinct()
    p = cdm.person.select(F.col("person_id").alias("subject_id"), "year_of_birth")
    op = cdm.observation_period.groupBy(F.col("person_id").alias("subject_id")).agg(F.min("observation_period_start_date").alias("obs_start"))
    j = target.join(p, "subject_id").join(op, "subject_id", "left").join(has(require).withColumn("_r", F.lit(1)), "subject_id", "left").join(has(exclude).withColumn("_x", F.lit(1)), "subject_id", "left")
    years = F.year("cohort_start_date") - F.col("year_of_birth")
    rules: list[tuple[str, Column]] = [("start", F.lit(True)), ("require", F.col("_r").isNotNull()), ("exclude", F.col("_x").isNull()), ("age", years.between(*age)), ("prior", F.coalesce(F.datediff("cohort_start_date", "obs_start") >= prior_days, F.lit(False)))]
    ok, aggs = F.lit(True), []
    for name, rule in rules:
        ok = ok & rule
        aggs += [F.countDistinct(F.when(ok, F.col("subject_id"))).alias(f"{name}_p"), F.count(F.when(ok, 1)).alias(f"{name}_e")]
    stack = ", ".join(f"CAST({k} AS BIGINT), '{name}', {name}_p, {name}_e" for k, (name, _) in enumerate(rules))
    return j.agg(*aggs).selectExpr(f"stack({len(rules)}, {stack}) AS (step, rule, persons, exposures)")


def mdrr(n_target: int, n_comparator: int, outcomes: int, alpha: float = 0.05, power: float = 0.8) -> float | None:
    """Minimum detectable relative risk."""
    total = n_target + n_comparator
    if not total or not outcomes or not n_target or not n_comparator:
        return None
    p = n_target / total
    z = NormalDist().inv_cdf
    return math.exp((z(1 - alpha / 2) + z(power)) * math.sqrt(1 / (outcomes * p * (1 - p))))


def survival_arms(target: DataFrame, comparator: DataFrame, outcome: DataFrame, end: int) -> DataFrame:
    """(treated, time, event) of both arms' first episodes."""
    parts = [outcome_substrate(arm, outcome, 0, end).select(F.lit(k).cast("long").alias("treated"), F.coalesce("days_to_event", F.col("days") - 1).alias("time"), (F.col("n_events") > 0).cast("long").alias("event")) for k, arm in ((1, target), (0, comparator))]
    return parts[0].unionByName(parts[1])


def kaplan_meier(frame: DataFrame, width: float = 30.4375) -> DataFrame:
    """By arm and bin of time: at risk at its start, events, and the product of 1 - events / at risk."""
    b = F.floor(F.col("time") / width).cast("long")
    counts = frame.groupBy("treated", b.alias("bin")).agg(F.count(F.lit(1)).alias("leaving"), F.sum("event").alias("events"))
    later = Window.partitionBy("treated").orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, 0)
    so_far = Window.partitionBy("treated").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    out = counts.withColumn("at_risk", F.sum("leaving").over(later))
    step = 1 - F.col("events") / F.col("at_risk")
    return out.withColumn("survival", F.round(F.when(F.min(step).over(so_far) <= 0, 0.0).otherwise(F.exp(F.sum(F.log(F.when(step > 0, step))).over(so_far))), 6)).drop("leaving")


def cox(frame: DataFrame, rounds: int = 30) -> dict[str, float] | None:
    """Hazard ratio of a two-group Cox model with Efron ties, from counts by time (Newton on one coefficient).

    The driver holds one row for each distinct day at risk, not one a person.
    """
    rows = frame.groupBy("time").agg(F.sum("treated").alias("t"), F.count(F.lit(1)).alias("n"), F.sum("event").alias("d"), F.sum(F.col("event") * F.col("treated")).alias("dt")).orderBy(F.desc("time")).collect()
    if not any(r["dt"] for r in rows) or not any(r["d"] - r["dt"] for r in rows):
        return None
    beta = 0.0
    for _ in range(rounds):
        score = info = 0.0
        n1 = n0 = 0
        for r in rows:
            n1, n0 = n1 + r["t"], n0 + r["n"] - r["t"]
            d, d1 = r["d"], r["dt"]
            score += d1
            for k in range(d):
                w1 = math.exp(beta) * (n1 - k / d * d1)
                p = w1 / (w1 + n0 - k / d * (d - d1))
                score -= p
                info += p * (1 - p)
        if info <= 0:
            return None
        step = score / info
        beta += step
        if abs(step) < 1e-10:
            break
    se = 1 / math.sqrt(info)
    return {"log_hr": beta, "se": se, "hr": math.exp(beta), "low": math.exp(beta - 1.959964 * se), "high": math.exp(beta + 1.959964 * se)}


def poisson_ratio(events1: int, time1: float, events0: int, time0: float) -> dict[str, float] | None:
    """Rate ratio of two groups with a Wald interval; the Poisson fit has this closed form."""
    if not (events1 and events0 and time1 and time0):
        return None
    b, se = math.log(events1 / time1) - math.log(events0 / time0), math.sqrt(1 / events1 + 1 / events0)
    return {"log_rr": b, "se": se, "rr": math.exp(b), "low": math.exp(b - 1.959964 * se), "high": math.exp(b + 1.959964 * se)}


def case_series(exposure: DataFrame, outcome: DataFrame, cdm: Cdm) -> DataFrame:
    """Per case: events and days within exposure, and outside it while observed."""
    ev = outcome.select("subject_id", F.col("cohort_start_date").alias("event_date")).distinct()
    op = cdm.observation_period.select(F.col("person_id").alias("subject_id"), "observation_period_start_date", "observation_period_end_date")
    days = op.groupBy("subject_id").agg(F.sum(day_diff(F.col("observation_period_end_date"), F.col("observation_period_start_date")) + 1).alias("days"))
    first = first_episode(exposure).join(op, "subject_id").where("cohort_start_date BETWEEN observation_period_start_date AND observation_period_end_date")
    first = first.select("subject_id", "cohort_start_date", F.least("cohort_end_date", "observation_period_end_date").alias("stop"))
    exposed_days = first.select("subject_id", "cohort_start_date", "stop", (day_diff(F.col("stop"), F.col("cohort_start_date")) + 1).alias("exposed_days"))
    seen = ev.join(op, "subject_id").where("event_date BETWEEN observation_period_start_date AND observation_period_end_date").select("subject_id", "event_date").distinct()
    j = seen.join(exposed_days, "subject_id")
    cases = j.groupBy("subject_id", "exposed_days").agg(F.count(F.lit(1)).alias("events"), F.count(F.when(F.col("event_date").between(F.col("cohort_start_date"), F.col("stop")), 1)).alias("exposed_events"))
    return cases.join(days, "subject_id").select("subject_id", "events", "exposed_events", "days", "exposed_days")


def conditional_irr(cases: DataFrame, rounds: int = 50) -> dict[str, float] | None:
    """Incidence rate ratio of a self-controlled case series: Newton steps whose terms Spark sums over all cases."""
    usable = staged(cases.where("exposed_days < days AND exposed_days > 0"))
    total = usable.agg(F.sum("exposed_events").alias("x"), F.sum("events").alias("n")).first()
    if not total["n"] or not total["x"] or total["x"] == total["n"]:
        return None
    beta = 0.0
    for _ in range(rounds):
        e = math.exp(beta) * F.col("exposed_days")
        p = e / (e + F.col("days") - F.col("exposed_days"))
        sums = usable.agg(F.sum(F.col("events") * p).alias("mean"), F.sum(F.col("events") * p * (1 - p)).alias("info")).first()
        step = (total["x"] - sums["mean"]) / sums["info"]
        beta += step
        if abs(step) < 1e-10:
            break
    se = 1 / math.sqrt(sums["info"])
    return {"log_irr": beta, "se": se, "irr": math.exp(beta), "low": math.exp(beta - 1.959964 * se), "high": math.exp(beta + 1.959964 * se)}


def outcome_rate_by_month(outcome: DataFrame, cdm: Cdm) -> DataFrame:
    """Observed outcome events and persons by month."""
    ev = outcome.select("subject_id", F.col("cohort_start_date").alias("event_date")).distinct()
    op = cdm.observation_period.select(F.col("person_id").alias("subject_id"), "observation_period_start_date", "observation_period_end_date")
    seen = ev.join(op, "subject_id").where("event_date BETWEEN observation_period_start_date AND observation_period_end_date")
    return seen.groupBy(month_key(F.col("event_date")).alias("month")).agg(F.count(F.lit(1)).alias("n_events"), F.countDistinct("subject_id").alias("n_subjects"))


def pathways(target: DataFrame, drugs: DataFrame, cap: int = 5) -> DataFrame:
    """(path, n_subjects): drugs of a person in order from the index, repeats in a row once, at most cap of them."""
    j = drugs.select(F.col("person_id").alias("subject_id"), "concept_id", "event_date").join(first_episode(target), "subject_id").where("event_date >= cohort_start_date")
    w = Window.partitionBy("subject_id").orderBy("event_date", "concept_id")
    changed = j.select("subject_id", "concept_id", "event_date").distinct().withColumn("_last", F.lag("concept_id").over(w)).where("_last IS NULL OR _last <> concept_id")
    first = changed.withColumn("layer", F.row_number().over(w)).where(F.col("layer") <= cap)
    path = first.groupBy("subject_id").agg(F.array_sort(F.collect_list(F.struct("layer", "concept_id"))).alias("p"))
    return path.groupBy(F.array_join(F.transform("p", lambda s: s["concept_id"].cast("string")), ">").alias("path")).agg(F.count(F.lit(1)).alias("n_subjects"))


def percentage_treated(target: DataFrame, drugs: DataFrame, cap: int = 5) -> DataFrame:
    """Persons by layer and drug, and their share of the cohort."""
    j = drugs.select(F.col("person_id").alias("subject_id"), "concept_id", "event_date").join(first_episode(target), "subject_id").where("event_date >= cohort_start_date")
    w = Window.partitionBy("subject_id").orderBy("event_date", "concept_id")
    changed = j.select("subject_id", "concept_id", "event_date").distinct().withColumn("_last", F.lag("concept_id").over(w)).where("_last IS NULL OR _last <> concept_id")
    layered = changed.withColumn("layer", F.row_number().over(w).cast("long")).where(F.col("layer") <= cap)
    size = target.agg(F.countDistinct("subject_id").alias("n_cohort"))
    counts = layered.groupBy("layer", "concept_id").agg(F.countDistinct("subject_id").alias("n_subjects"))
    return counts.join(F.broadcast(size), F.lit(True)).withColumn("share", F.round(F.col("n_subjects") / F.col("n_cohort"), 6)).drop("n_cohort")


def auroc(frame: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """Rank-sum AUROC with mid-ranks, from counts by score and how many lie below each."""
    by = running_sums(frame.groupBy(score).agg(F.sum(label).alias("pos"), F.count(F.lit(1)).alias("n")), score, ["n"])
    r = by.withColumn("_rank", F.col("before_n") + (F.col("n") + 1) / 2)
    total = r.agg(F.sum(F.col("_rank") * F.col("pos")).alias("s"), F.sum("pos").alias("p"), F.sum("n").alias("n"))
    return total.select(F.round((F.col("s") - F.col("p") * (F.col("p") + 1) / 2) / (F.col("p") * (F.col("n") - F.col("p"))), 6).alias("auroc"))


def auprc(frame: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """Area under precision by recall, from the highest score down; trapezoids between distinct scores.

    At recall 0 the precision is that of the highest score.
    """
    negated = frame.select((-F.col(score)).alias("s"), F.col(label).alias("label"))
    by = running_sums(negated.groupBy("s").agg(F.sum("label").alias("pos"), F.count(F.lit(1)).alias("n")), "s", ["pos", "n"])
    total = frame.agg(F.sum(label).alias("positives"))
    after = (F.col("before_pos") + F.col("pos")) / (F.col("before_n") + F.col("n"))
    before = F.when(F.col("before_n") > 0, F.col("before_pos") / F.col("before_n")).otherwise(after)
    area = by.join(F.broadcast(total), F.lit(True)).agg(F.sum(F.col("pos") / F.col("positives") * (before + after) / 2).alias("a"))
    return area.select(F.round("a", 6).alias("auprc"))


def calibration(frame: DataFrame, bins: int = 10) -> DataFrame:
    """By tenth of predicted risk: persons, mean prediction and observed share."""
    edges = summary(frame, "score", [k / bins for k in range(1, bins)]).select(F.array(*[f"q{k}" for k in range(bins - 1)]).alias("e"))
    bin_ = F.size(F.filter("e", lambda x: x < F.col("score"))).cast("long")
    return frame.join(F.broadcast(edges), F.lit(True)).groupBy(bin_.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("score"), 6).alias("mean_predicted"), F.round(F.avg("label"), 6).alias("observed"))


def thresholds(frame: DataFrame) -> DataFrame:
    """Confusion counts at 0.1 to 0.9."""
    t = F.explode(F.array(*[F.lit(k / 10) for k in range(1, 10)])).alias("threshold")
    e = frame.select("score", "label", t)
    positive = F.col("score") >= F.col("threshold")
    return e.groupBy("threshold").agg(F.count(F.when(positive & (F.col("label") == 1), 1)).alias("tp"), F.count(F.when(positive & (F.col("label") == 0), 1)).alias("fp"), F.count(F.when(~positive & (F.col("label") == 1), 1)).alias("fn"), F.count(F.when(~positive & (F.col("label") == 0), 1)).alias("tn"))


def fitted_scores(labelled: DataFrame, prior: DataFrame, top: int) -> DataFrame:
    """(subject_id, label, score): logistic regression of label on having each of the top most common concepts of prior.

    labelled has subject_id and label (0 or 1), prior subject_id and concept_id;
    the design is sparse in rows and bounded in columns.
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    names = [r["concept_id"] for r in prior.groupBy("concept_id").agg(F.countDistinct("subject_id").alias("n")).orderBy(F.desc("n"), "concept_id").limit(top).collect()]
    x = prior.where(F.col("concept_id").isin(names)).groupBy("subject_id").agg(*[F.max(F.when(F.col("concept_id") == c, 1.0).otherwise(0.0)).alias(f"x{c}") for c in names])
    data = labelled.select("subject_id", F.col("label").cast("double").alias("label")).join(x, "subject_id", "left").fillna(0.0)
    data = VectorAssembler(inputCols=[f"x{c}" for c in names], outputCol="features").transform(data)
    return LogisticRegression(maxIter=50, tol=1e-9).fit(data).transform(data).select("subject_id", "label", vector_to_array("probability")[1].alias("score"))


def propensity(target: DataFrame, comparator: DataFrame, ev: DataFrame, top: int = 20) -> DataFrame:
    """(subject_id, label, score, preference): the chance of being in the target, by the most common prior concepts.

    The preference score shifts the logit by the share of the target.  Someone
    in both arms counts as of the target.
    """
    first = first_episode(target)
    both = first.withColumn("label", F.lit(1.0)).unionByName(first_episode(comparator).join(first.select("subject_id"), "subject_id", "left_anti").withColumn("label", F.lit(0.0)))
    prior = ev.select(F.col("person_id").alias("subject_id"), "concept_id", "event_date").join(both, "subject_id").where("event_date < cohort_start_date AND concept_id <> 0")
    fitted = fitted_scores(both, prior.select("subject_id", "concept_id"), top)
    share = both.agg(F.avg("label").alias("q"))
    inside = F.greatest(F.least("score", F.lit(1 - 1e-12)), F.lit(1e-12))
    logit = F.log(inside / (1 - inside)) - F.log(F.col("q") / (1 - F.col("q")))
    return fitted.join(F.broadcast(share), F.lit(True)).select("subject_id", "label", "score", (1 / (1 + F.exp(-logit))).alias("preference"))


def equipoise(scores: DataFrame, low: float = 0.3, high: float = 0.7) -> DataFrame:
    """By arm: persons, and the share of them whose preference lies between low and high."""
    return scores.groupBy(F.col("label").cast("long").alias("label")).agg(F.count(F.lit(1)).alias("n_persons"), F.round(F.avg(F.col("preference").between(low, high).cast("double")), 6).alias("equipoise"))


def dechallenge(target: DataFrame, outcome: DataFrame, window: int = 30) -> DataFrame:
    """Nested counts of persons: with an outcome in an episode, one that ended after it, a later episode, an outcome in that."""
    e = target.select("subject_id", F.col("cohort_start_date").alias("s"), F.col("cohort_end_date").alias("e")).distinct()
    o = outcome.select("subject_id", F.col("cohort_start_date").alias("o")).distinct()
    hit = e.join(o, "subject_id").where("o BETWEEN s AND e").groupBy("subject_id").agg(F.min(F.struct("o", "e")).alias("h")).select("subject_id", F.col("h.o").alias("o"), F.col("h.e").alias("e"))
    stopped = hit.where(F.datediff("e", "o") <= window)
    again = stopped.join(e.select("subject_id", F.col("s").alias("s2"), F.col("e").alias("e2")), "subject_id").where("s2 > e")
    re_hit = again.join(o.select("subject_id", F.col("o").alias("o2")), "subject_id").where("o2 BETWEEN s2 AND e2")
    counts = [d.agg(F.countDistinct("subject_id").alias(n)) for d, n in ((hit, "cases"), (stopped, "dechallenge"), (again, "rechallenge"), (re_hit, "rechallenge_fail"))]
    out = counts[0]
    for c in counts[1:]:
        out = out.join(F.broadcast(c), F.lit(True))
    return out


def orphan_concepts(cdm: Cdm, resolved: DataFrame, domain: str) -> DataFrame:
    """Vocabulary neighbours outside a resolved set that carry data."""
    near = cdm.concept_ancestor.join(resolved.select(F.col("concept_id").alias("descendant_concept_id")), "descendant_concept_id", "left_semi").select(F.col("ancestor_concept_id").alias("a"))
    sisters = cdm.concept_ancestor.join(near.distinct(), F.col("ancestor_concept_id") == F.col("a"), "left_semi").select(F.col("descendant_concept_id").alias("concept_id")).distinct()
    candidates = sisters.join(resolved, "concept_id", "left_anti")
    return events(cdm, domain).join(candidates, "concept_id", "left_semi").groupBy("concept_id").agg(F.count(F.lit(1)).alias("n_records"), F.countDistinct("person_id").alias("n_subjects"))
