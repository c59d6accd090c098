"""Analyses that a session runs by name: what each counts, what it takes, and how it is computed."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import cohorts, concepts, temporal
from ..operators.gate import band
from . import analyses, population, scores, standard

if TYPE_CHECKING:
    from ..session import Session


@dataclass(frozen=True)
class Entry:
    """A named analysis: what its rows count, whether it needs a cohort, its parameters and how it is computed.

    compute takes (session, cohort or None, parameters) and gives an aggregate
    frame with no column but strata, the counts named and the values.
    """

    name: str
    unit: str
    compute: Callable[[Session, DataFrame | None, dict], DataFrame]
    counts: tuple[str, ...]
    scoped: bool = True
    companion: str | None = None
    ratios: Mapping[str, tuple[str, str]] = field(default_factory=dict)
    parameters: Mapping[str, object] = field(default_factory=dict)
    columns: tuple[str, ...] | None = None
    combine: str = "sum"


def _balanced(s: Session, target: DataFrame, other: DataFrame, p: dict) -> DataFrame:
    """Persons of both arms with each prior concept, and the standardised difference of their banded shares."""
    ev, sides = cohorts.events(s.cdm, p["domain"]), []
    for name, arm in (("n_target", target), ("n_comparator", other)):
        size = arm.agg(F.countDistinct("subject_id").alias("_size"))
        counts = analyses.covariate_prevalence(arm, ev, p["start"], p["end"]).select("concept_id", F.col("n_subjects").alias(name))
        sides.append(counts.join(F.broadcast(size), F.lit(True)).withColumn(f"share_{name}", band(F.col(name), s.policy.band) / band(F.col("_size"), s.policy.band)).drop("_size"))
    a, b = F.col("share_n_target"), F.col("share_n_comparator")
    spread = F.sqrt((a * (1 - a) + b * (1 - b)) / 2)
    return sides[0].join(sides[1], "concept_id").select("concept_id", "n_target", "n_comparator", F.when(spread > 0, F.round((a - b) / spread, 5)).alias("smd"))


def _steps(s: Session, c: DataFrame, p: dict) -> DataFrame:
    return analyses.attrition(c, s.cdm, p["require"], p["exclude"], tuple(p["age"]), p["prior"])


def _km(s: Session, c: DataFrame, p: dict) -> DataFrame:
    """At risk and events by bin of time; survival is the product of 1 less the banded share of events."""
    from pyspark.sql import Window

    found = analyses.kaplan_meier(analyses.survival_arms(c, s.cohort(p["comparator"]), s.cohort(p["outcome"]), p["end"]), p["width"]).where(F.col("at_risk") >= s.policy.tab)
    step = 1 - band(F.col("events"), s.policy.band) / F.greatest(band(F.col("at_risk"), s.policy.band), F.lit(1))
    so_far = Window.partitionBy("treated").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    return found.select("treated", "bin", F.col("at_risk").alias("n_persons"), F.round(F.exp(F.sum(F.log(F.greatest(step, F.lit(1e-12)))).over(so_far)), 6).alias("survival"))


def _fitted(s: Session, found: dict | None, **counts: int) -> DataFrame:
    names = ("estimate", "low", "high", "se")
    values = [None] * 4 if found is None else [found[next(k for k in keys if k in found)] for keys in (("hr", "irr", "rr"), ("low",), ("high",), ("se",))]
    return s.spark.createDataFrame([(*counts.values(), *values)], ", ".join([*(f"{c} long" for c in counts), *(f"{n} double" for n in names)]))


def _effect(s: Session, c: DataFrame, p: dict) -> DataFrame:
    arms = population.arm_times(c, s.cohort(p["comparator"]), s.cohort(p["outcome"]), p["end"])
    n = arms.agg(F.sum("treated").alias("t"), F.sum(1 - F.col("treated")).alias("c"), F.sum("event").alias("d")).first()
    fit = analyses.cox(arms) if p["model"] == "cox" else population.rate_ratio(arms).first().asDict()
    return _fitted(s, fit, n_target=n["t"], n_comparator=n["c"], n_outcomes=n["d"])


def _detectable(s: Session, c: DataFrame, p: dict) -> DataFrame:
    arms = population.arm_times(c, s.cohort(p["comparator"]), s.cohort(p["outcome"]), p["end"])
    n = arms.agg(*[F.sum(x).cast("long").alias(k) for k, x in (("t", F.col("treated")), ("c", 1 - F.col("treated")), ("d", F.col("event")))]).first()
    floor = lambda x: x // s.policy.band * s.policy.band
    return s.spark.createDataFrame([(n["t"], n["c"], n["d"], analyses.mdrr(floor(n["t"]), floor(n["c"]), floor(n["d"])))], "n_target long, n_comparator long, n_outcomes long, mdrr double")


def _ratio_in_series(s: Session, c: DataFrame, p: dict) -> DataFrame:
    cases = analyses.case_series(c, s.cohort(p["outcome"]), s.cdm)
    n = cases.agg(F.count(F.lit(1)).alias("n"), F.sum("events").alias("e")).first()
    return _fitted(s, analyses.conditional_irr(cases), n_persons=n["n"], n_events=n["e"] or 0)


def _predicted(s: Session, c: DataFrame, p: dict) -> DataFrame:
    return population.prediction_model(c, s.cohort(p["outcome"]), cohorts.events(s.cdm, p["domain"]), s.cdm, top=p["top"])


def _performance(s: Session, c: DataFrame, p: dict) -> DataFrame:
    frame = _predicted(s, c, p)
    n = frame.agg(F.count(F.lit(1)).alias("n_persons"), F.sum("label").cast("long").alias("n_outcomes"))
    return n.join(F.broadcast(analyses.auroc(frame)), F.lit(True)).join(F.broadcast(analyses.auprc(frame)), F.lit(True))


def _calibrated(s: Session, c: DataFrame, p: dict) -> DataFrame:
    """Shares only of bins that hold enough persons for a distribution."""
    found = analyses.calibration(_predicted(s, c, p))
    return found.withColumns({x: F.when(F.col("n") >= s.policy.dist, F.col(x)) for x in ("mean_predicted", "observed")})


def _nested(s: Session, c: DataFrame, p: dict) -> DataFrame:
    """The nested counts, a row each, so that the gate can drop one."""
    row = analyses.dechallenge(c, s.cohort(p["outcome"]), p["window"])
    return row.selectExpr("stack(4, 'cases', cases, 'dechallenge', dechallenge, 'rechallenge', rechallenge, 'rechallenge_fail', rechallenge_fail) AS (step, n_persons)")


def _targets(s: Session, c: DataFrame, p: dict) -> DataFrame:
    """Binary and continuous covariates in one frame; a continuous one counts the persons with a value."""
    binary = analyses.covariate_prevalence(c, cohorts.events(s.cdm, p["domain"]), p["start"], p["end"]).select(F.lit("binary").alias("kind"), "concept_id", "n_subjects", F.lit(None).cast("double").alias("mean"))
    values = analyses.covariate_values(c, s.cdm, p["start"], p["end"])
    continuous = values.select(F.lit("continuous").alias("kind"), "concept_id", F.col("count_value").alias("n_subjects"), F.when(F.col("count_value") >= s.policy.dist, F.col("avg_value")).alias("mean"))
    return binary.unionByName(continuous)


def entries() -> list[Entry]:
    """All that come with the engine."""
    ev = lambda s, p: cohorts.events(s.cdm, p["domain"])
    out = lambda s, p: s.cohort(p["outcome"])
    window = {"domain": "condition", "start": -365, "end": 0}
    arms = {"comparator": 3, "outcome": 1, "end": 365}
    rules = {"require": [2004], "exclude": [2007], "age": [30, 80], "prior": 100}
    one = ("n_subjects",)
    dist = ("count_value",)
    made = [
        Entry("demo.person_count_by_gender", "person", lambda s, c, p: (s.cdm.person if c is None else s.cdm.person.join(c.select(F.col("subject_id").alias("person_id")).distinct(), "person_id", "left_semi")).groupBy("gender_concept_id").agg(F.countDistinct("person_id").alias("n_persons")), ("n_persons",), scoped=False),
        Entry("incidence.rate", "person", lambda s, c, p: analyses.incidence_rate(c, out(s, p), s.cdm, p["start"], p["end"], p["strata"]).drop("rate", "person_days", "n_outcomes"), ("n_with_outcome", "n_persons"), ratios={"proportion": ("n_with_outcome", "n_persons")}, parameters={"outcome": 1, "start": 0, "end": 365, "strata": ()}),
        Entry("cohortdx.cohort_count", "record", lambda s, c, p: analyses.cohort_count(c), ("entries",), companion="subjects"),
        Entry("cohortdx.time_series", "record", lambda s, c, p: analyses.time_series(c), ("records", "person_days"), companion="subjects"),
        Entry("cohortdx.visit_context", "person", lambda s, c, p: analyses.visit_context(c, s.cdm), one),
        Entry("cohortdx.index_event_breakdown", "record", lambda s, c, p: analyses.index_breakdown(c, s.cdm, p["domain"]), ("n_events",), companion="n_subjects", parameters={"domain": "condition"}),
        Entry("cohortdx.time_distribution", "dist", lambda s, c, p: analyses.time_distribution(c, s.cdm), dist),
        Entry("cohortdx.temporal_prevalence", "person", lambda s, c, p: population.temporal_prevalence(c, ev(s, p), p["windows"]).drop("share"), one, parameters={"domain": "condition", "windows": ((-365, -1), (0, 0), (1, 365))}),
        Entry("cohortdx.temporal_covariate_value_dist", "dist", lambda s, c, p: population.temporal_values(c, s.cdm, p["windows"]), dist, parameters={"windows": ((-365, -1), (0, 365))}),
        Entry("cohortdx.cohort_overlap", "person", lambda s, c, p: analyses.overlap(c, s.cohort(p["other"])), ("either", "both", "a_only", "b_only"), parameters={"other": 2}),
        Entry("cohortdx.included_source_concepts", "record", lambda s, c, p: population.source_concepts(s.cdm, concepts.ids(s.cdm, p["concepts"]), p["domain"]), ("n_records",), scoped=False, companion="n_subjects", parameters={"concepts": [2001], "domain": "condition"}),
        Entry("cohortdx.orphan_concepts", "record", lambda s, c, p: analyses.orphan_concepts(s.cdm, s.expand_concept_set(p["concepts"]), p["domain"]), ("n_records",), scoped=False, companion="n_subjects", parameters={"concepts": [2001], "domain": "condition"}),
        Entry("fe.prevalence", "person", lambda s, c, p: analyses.covariate_prevalence(c, ev(s, p), p["start"], p["end"]).drop("share"), one, parameters=window),
        Entry("fe.continuous", "dist", lambda s, c, p: analyses.covariate_values(c, s.cdm, p["start"], p["end"]), dist, parameters={"start": -365, "end": 0}),
        Entry("fe.demographics", "person", lambda s, c, p: analyses.demographics(c, s.cdm), one),
        Entry("fe.table1", "person", lambda s, c, p: analyses.table1(c, s.cdm, ev(s, p)), one, parameters={"domain": "condition"}),
        Entry("fe.age_distribution", "dist", lambda s, c, p: population.age_distribution(c, s.cdm), dist),
        Entry("fe.comorbidity_index", "person", lambda s, c, p: scores.component_index(s.cdm, c, p["seeds"] or scores.COMPONENTS[p["index"]]).groupBy("score").agg(F.countDistinct("subject_id").alias("n_subjects")), one, parameters={"index": "charlson", "seeds": ()}),
        Entry("char.time_to_event", "record", lambda s, c, p: analyses.time_to_event(c, ev(s, p), p["width"], p["start"], p["end"], p["cap"]), ("n_events",), companion="n_subjects", parameters={"domain": "condition", "width": 30, "start": -360, "end": 359, "cap": 3}),
        Entry("char.target_covariates", "person", _targets, one, parameters=window),
        Entry("char.dechallenge_rechallenge", "person", _nested, ("n_persons",), parameters={"outcome": 1, "window": 30}),
        Entry("char.risk_factor_smd", "person", lambda s, c, p: _balanced(s, (marked := population.labelled(cohorts.first_episode(c), out(s, p), 1, p["risk"])).where("label = 1"), marked.where("label = 0"), p), ("n_target", "n_comparator"), parameters=window | {"outcome": 1, "risk": 365}),
        Entry("cm.covariate_balance", "person", lambda s, c, p: _balanced(s, c, s.cohort(p["comparator"]), p), ("n_target", "n_comparator"), parameters=window | {"comparator": 3}),
        Entry("cm.attrition", "record", lambda s, c, p: _steps(s, c, p), ("exposures",), companion="persons", parameters=rules),
        Entry("cm.followup_distribution", "dist", lambda s, c, p: standard.distribution(analyses.outcome_substrate(c, out(s, p), p["start"], p["end"]), "days"), dist, parameters={"outcome": 1, "start": 0, "end": 365}),
        Entry("cm.kaplan_meier", "person", _km, ("n_persons",), parameters=arms | {"width": 30.4375}),
        Entry("cm.effect_estimate", "person", _effect, ("n_target", "n_comparator", "n_outcomes"), parameters=arms | {"model": "cox"}),
        Entry("cm.interaction_estimate", "person", lambda s, c, p: population.interaction(population.arm_times(c, s.cohort(p["comparator"]), out(s, p), p["end"]), s.cdm, p["by"], p["cuts"], p["concepts"]).drop("days1", "days0"), ("events1", "events0"), parameters=arms | {"by": "sex", "cuts": (40, 60), "concepts": ()}),
        Entry("cm.mdrr", "person", _detectable, ("n_target", "n_comparator", "n_outcomes"), parameters=arms),
        Entry("cm.propensity_distribution", "person", lambda s, c, p: analyses.propensity(c, s.cohort(p["comparator"]), ev(s, p), p["top"]).groupBy(F.col("label").cast("long").alias("treated"), F.floor(F.col("preference") * 20).cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("n_persons")), ("n_persons",), parameters={"comparator": 3, "domain": "condition", "top": 20}),
        Entry("sccs.attrition", "record", lambda s, c, p: population.series_attrition(c, out(s, p), s.cdm), ("events",), companion="cases", parameters={"outcome": 1}),
        Entry("sccs.outcome_rate_per_month", "record", lambda s, c, p: analyses.outcome_rate_by_month(c, s.cdm), ("n_events",), companion="n_subjects"),
        Entry("sccs.count_histograms", "record", lambda s, c, p: population.series_histogram(c, out(s, p), s.cdm, p["width"]), ("n_events",), companion="n_subjects", parameters={"outcome": 1, "width": 30}),
        Entry("sccs.assumption_checks", "person", lambda s, c, p: population.series_checks(c, out(s, p), s.cdm, p["window"]).join(F.broadcast(c.agg(F.countDistinct("subject_id").alias("n_persons"))), F.lit(True)), ("n_persons",), parameters={"outcome": 1, "window": 30}),
        Entry("sccs.incidence_rate_ratio", "record", _ratio_in_series, ("n_events",), companion="n_persons", parameters={"outcome": 1}),
        Entry("plp.attrition", "person", lambda s, c, p: population.prediction_attrition(c, out(s, p), s.cdm), ("persons", "outcomes"), parameters={"outcome": 1}),
        Entry("plp.covariate_summary", "person", lambda s, c, p: population.prediction_covariates(c, out(s, p), ev(s, p), s.cdm).drop("share"), one, parameters={"outcome": 1, "domain": "condition"}),
        Entry("plp.performance", "person", _performance, ("n_persons", "n_outcomes"), parameters={"outcome": 1, "domain": "condition", "top": 20}),
        Entry("plp.calibration", "person", _calibrated, ("n",), parameters={"outcome": 1, "domain": "condition", "top": 20}),
        Entry("plp.threshold", "person", lambda s, c, p: analyses.thresholds(_predicted(s, c, p)), ("tp", "fp", "fn", "tn"), parameters={"outcome": 1, "domain": "condition", "top": 20}),
        Entry("plp.diagnostic", "person", lambda s, c, p: population.prediction_diagnostic(c, out(s, p), ev(s, p), s.cdm).drop("incidence", "events_per_variable"), ("persons", "outcomes"), parameters={"outcome": 1, "domain": "condition"}),
        Entry("txpath.pathways", "person", lambda s, c, p: population.gated_pathways(analyses.pathways(c, ev(s, p), p["cap"]), s.policy.tab, p["cap"]), one, parameters={"domain": "procedure", "cap": 5}),
        Entry("txpath.percentage_treated", "person", lambda s, c, p: analyses.percentage_treated(c, ev(s, p), p["cap"]).drop("share"), one, parameters={"domain": "procedure", "cap": 5}),
        Entry("txpath.duration_eras", "dist", lambda s, c, p: population.duration_eras(c, ev(s, p)), dist, parameters={"domain": "condition"}),
        Entry("temporal.covariates", "record", lambda s, c, p: temporal.temporal_covariates(ev(s, p), c, s.cdm.observation_period, p["start"], p["end"], p["width"]).groupBy("concept_id", "bin").agg(F.countDistinct("subject_id").alias("n_subjects"), F.sum("n_records").alias("n_records")), ("n_records",), companion="n_subjects", parameters=window | {"width": 30}),
    ]
    # Result tables that carry another name of an analysis.
    same = {"cd.cohort_count": "cohortdx.cohort_count", "cd.time_series": "cohortdx.time_series", "cd.visit_context": "cohortdx.visit_context", "cd.index_event_breakdown": "cohortdx.index_event_breakdown", "cd.temporal_covariate_value": "cohortdx.temporal_prevalence", "cm.covariate": "fe.prevalence", "es.cohort_count": "cohortdx.cohort_count", "es.incidence": "incidence.rate", "es.effect": "cm.effect_estimate", "es.diagnostics": "cm.covariate_balance", "sccs.result": "sccs.incidence_rate_ratio", "plp.evaluation": "plp.performance"}
    by_name = {e.name: e for e in made}
    return made + [Entry(**(vars(by_name[of]) | {"name": alias})) for alias, of in same.items()]
