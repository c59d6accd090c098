"""Plans: named populations, and outputs made of their episodes, each a DataFrame."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expr import day_diff
from ..operators import cohorts, features, survival, temporal
from ..operators.gate import Policy, age_bands, assert_min_persons
from ..sources.blueprint import Blueprint
from ..sources.cdm import Cdm
from . import extract as rows
from .extract import SpecError

MAX_OUTPUTS = 100


@dataclass(frozen=True)
class Plan:
    """Populations by name in order of declaration, outputs by name, and the cohort that all of it is within."""

    populations: Mapping[str, dict] = field(default_factory=dict)
    outputs: Mapping[str, dict] = field(default_factory=dict)
    scope: DataFrame | None = None


def measured(cdm: Cdm, domain: str, concepts=None) -> DataFrame:
    """Events of a domain with a value and its normal range, null where the domain has none."""
    ev = cohorts.events(cdm, domain, concepts)
    if domain != "measurement":
        return ev.select("*", *[F.lit(None).cast("double").alias(c) for c in ("value", "range_low", "range_high")])
    m = cdm.measurement.select(F.col("measurement_id").alias("event_key"), F.col("value_as_number").alias("value"), "range_low", "range_high")
    return ev.join(m, "event_key")


def check(plan: Plan) -> None:
    """Raises SpecError for unknown kinds, and for populations that are used before they are declared."""
    known = {"base"}
    for name, spec in plan.populations.items():
        if spec.get("kind") not in POPULATIONS:
            raise SpecError(f"unknown population kind {spec.get('kind')!r}")
        for used in [*spec.get("members", ()), *([spec["of"]] if "of" in spec else [])]:
            if used not in known:
                raise SpecError(f"{name} uses {used} before it is declared")
        known.add(name)
    if len(plan.outputs) > MAX_OUTPUTS:
        raise SpecError(f"at most {MAX_OUTPUTS} outputs")
    for name, spec in plan.outputs.items():
        if spec.get("kind") not in OUTPUTS:
            raise SpecError(f"unknown output kind {spec.get('kind')!r}")
        if spec.get("population", "base") not in known:
            raise SpecError(f"{name} uses a population that isn't declared")


def _filtered(cdm: Cdm, of: DataFrame, spec: dict) -> DataFrame:
    policy = spec.get("policy")
    if policy is None:
        # Without a policy a filter on an index date has no meaning where persons have several.
        if of.groupBy("subject_id").count().where("count > 1").limit(1).count():
            raise SpecError("episodes recur: an episode policy is needed")
        policy = "any_episode"
    return cohorts.intersect(of, cohorts.population(of, cdm, spec["filter"], policy))


def _recurrent_filtered(cdm: Cdm, of: DataFrame, spec: dict) -> DataFrame:
    return cohorts.flag(of, cdm, spec["filter"]).where(F.coalesce("ok", F.lit(False))).select(*cohorts.COHORT)


POPULATIONS: dict[str, Callable[[Cdm, dict[str, DataFrame], dict], DataFrame]] = {
    "stored": lambda cdm, made, s: cohorts.stored(cdm, s["id"]),
    "persons": lambda cdm, made, s: cohorts.of_persons(cdm, s["ids"]),
    "events": lambda cdm, made, s: cohorts.from_events(cdm, s["domain"], s["concepts"], s.get("value_bin")),
    "index": lambda cdm, made, s: cohorts.index_events(cdm, s["domain"], s["concepts"], s.get("pick", "first"), s.get("days")),
    "filter": lambda cdm, made, s: _filtered(cdm, made[s.get("of", "base")], s),
    "filter_episodes": lambda cdm, made, s: _recurrent_filtered(cdm, made[s.get("of", "base")], s),
    "include": lambda cdm, made, s: cohorts.include(made[s.get("of", "base")], cdm, list(s["criteria"])),
    "combine": lambda cdm, made, s: cohorts.combine(s["op"], [made[m] for m in s["members"]]),
}


def populations(cdm: Cdm, plan: Plan) -> dict[str, DataFrame]:
    """Every population's episodes; base is the scope, or all observation periods.  Each keeps to the scope's persons."""
    made = {"base": plan.scope.select(*cohorts.COHORT).distinct() if plan.scope is not None else cohorts.everyone(cdm)}
    for name, spec in plan.populations.items():
        found = POPULATIONS[spec["kind"]](cdm, made, spec)
        made[name] = cohorts.intersect(found, plan.scope) if plan.scope is not None else found
    return made


def baseline(cdm: Cdm, cohort: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """One row an episode: sex, age and its group at the index, days observed before and after it."""
    person = cdm.person.select(F.col("person_id").alias("subject_id"), "gender_concept_id", "year_of_birth", "race_concept_id", "ethnicity_concept_id")
    seen = temporal.observed_once(cohort, cdm.observation_period)
    out = cohort.select(*cohorts.COHORT).distinct().join(person, "subject_id").join(seen, list(cohorts.COHORT), "left")
    age = (F.year("cohort_start_date") - F.col("year_of_birth")).cast("long")
    out = out.select(*cohorts.COHORT, "gender_concept_id", "race_concept_id", "ethnicity_concept_id", F.when(age >= 0, age).alias("age"), day_diff(F.col("cohort_start_date"), F.col("obs_start")).alias("prior_days"), day_diff(F.col("obs_end"), F.col("cohort_start_date")).alias("future_days"))
    return age_bands(out, person="subject_id", policy=policy)


def membership(cohort: DataFrame, definition: int = 1) -> DataFrame:
    """Standard cohort rows."""
    return cohort.select(F.lit(definition).cast("long").alias("cohort_definition_id"), *cohorts.COHORT).distinct()


def _risk(cdm: Cdm, c: DataFrame, s: dict) -> tuple[survival.Risk, DataFrame, DataFrame]:
    risk = survival.Risk(s.get("start", 0), s.get("end"), s.get("washout", 0), s.get("admin_end"))
    outcomes = None
    for k, o in enumerate(s["outcomes"], 1):
        ev = cohorts.events(cdm, o["domain"], o["concepts"]).select("person_id", F.lit(k).cast("long").alias("outcome"), "event_date")
        outcomes = ev if outcomes is None else outcomes.unionByName(ev)
    return risk, survival.risk_sets(c, cdm.observation_period, cdm.death, risk), outcomes


def _by_episode(cdm: Cdm, c: DataFrame, s: dict) -> DataFrame:
    """Features of each episode; days count from its own start."""
    keys = ["person_id", "cohort_start_date", "cohort_end_date"]
    roster = c.withColumnRenamed("subject_id", "person_id")
    ev = temporal.index_window(measured(cdm, s["domain"]), c)
    return features.features(ev, roster, s["features"], keys)


def _by_person(cdm: Cdm, c: DataFrame, s: dict) -> DataFrame:
    roster = c.select(F.col("subject_id").alias("person_id"))
    ev = measured(cdm, s["domain"])
    if any(f.window for f in s["features"]):
        ev = temporal.index_window(ev, cohorts.first_episode(c))
    return features.features(ev, roster, s["features"])


def _of(c: DataFrame, ev: DataFrame) -> DataFrame:
    return ev.join(c.select(F.col("subject_id").alias("person_id")).distinct(), "person_id", "left_semi")


def _survival(cdm: Cdm, c: DataFrame, s: dict) -> DataFrame:
    risk, sets, outcomes = _risk(cdm, c, s)
    numbers = list(range(1, len(s["outcomes"]) + 1))
    return {
        "survival": lambda: survival.survival(sets, outcomes, numbers, risk, s.get("last", False)),
        "competing_risk": lambda: survival.competing_risk(sets, outcomes, numbers, risk),
        "recurrent_events": lambda: survival.recurrent(sets, outcomes, risk),
        "counting_process": lambda: survival.counting_process(sets, outcomes, risk),
    }[s["kind"]]()


def _multi_state(cdm: Cdm, c: DataFrame, s: dict) -> DataFrame:
    states, edges = survival.transition_graph(s["edges"])
    ev = None
    for state, o in s["states"].items():
        part = cohorts.events(cdm, o["domain"], o["concepts"]).select("person_id", F.lit(state).alias("state"), "event_date")
        ev = part if ev is None else ev.unionByName(part)
    sets = survival.risk_sets(c, cdm.observation_period, cdm.death, survival.Risk(s.get("start", 0), s.get("end"), s.get("washout", 0), s.get("admin_end")))
    return survival.multi_state(sets, ev, states, edges, s["first"])


OUTPUTS: dict[str, Callable[[Cdm, DataFrame, dict], DataFrame]] = {
    "wide": lambda cdm, c, s: features.wide(_of(c, temporal.event_select(measured(cdm, s["domain"], list(s["concepts"])), ["person_id", "concept_id"], 1, s.get("pick", "first") == "last")), c.withColumnRenamed("subject_id", "person_id"), s["concepts"]),
    "episode_wide": lambda cdm, c, s: features.wide(temporal.event_select(temporal.index_window(measured(cdm, s["domain"], list(s["concepts"])), c, *s.get("window", (None, None))), ["person_id", "cohort_start_date", "cohort_end_date", "concept_id"], 1, s.get("pick", "first") == "last"), c.withColumnRenamed("subject_id", "person_id"), s["concepts"], keys=["person_id", "cohort_start_date", "cohort_end_date"]),
    "events": lambda cdm, c, s: temporal.by_spec(measured(cdm, s["domain"], s.get("concepts")), c, s.get("temporal", {})),
    "declared_dictionary": lambda cdm, c, s: features.declared_dictionary(cdm.spark, s["concepts"]),
    "features": _by_person,
    "episode_features": _by_episode,
    "sparse": lambda cdm, c, s: features.sparse(_of(c, measured(cdm, s["domain"])))[0],
    "sparse_reference": lambda cdm, c, s: features.sparse(_of(c, measured(cdm, s["domain"])))[1],
    "baseline": lambda cdm, c, s: baseline(cdm, c),
    "membership": lambda cdm, c, s: membership(c, s.get("id", 1)),
    "survival": _survival,
    "competing_risk": _survival,
    "recurrent_events": _survival,
    "counting_process": _survival,
    "multi_state": _multi_state,
    "intervals": lambda cdm, c, s: temporal.intervals(cohorts.events(cdm, s["domain"], s.get("concepts")), c, s.get("relation", "overlaps"), s.get("window"), s.get("pick", "all"), s.get("n", 1)),
    "temporal_covariates": lambda cdm, c, s: temporal.temporal_covariates(cohorts.events(cdm, s["domain"], s.get("concepts")), c, cdm.observation_period, s["start"], s["end"], s["width"]),
    "person_period": lambda cdm, c, s: temporal.person_period(c, cdm.observation_period, s["start"], s["end"], s["width"]),
    "dictionary": lambda cdm, c, s: features.dictionary(cdm, _of(c, cohorts.events(cdm, s["domain"], s.get("concepts")))),
    "derived": lambda cdm, c, s: _of(c, features.derived(cdm, s["reference"])),
    "rows": lambda cdm, c, s: rows.extract({s["table"]: cdm.table(s["table"]), "visit_occurrence": cdm.visit_occurrence}, Blueprint({s["table"]: cdm.table(s["table"])}), s["table"], cohort=c, **{k: v for k, v in s.items() if k not in ("kind", "population", "table")}),
}


def _person_of(df: DataFrame) -> str | None:
    return next((c for c in ("person_id", "subject_id") if c in df.columns), None)


def run(cdm: Cdm, plan: Plan, policy: Policy | None = Policy()) -> dict[str, DataFrame]:
    """All outputs by name.

    With a policy each output's population must hold enough persons, which is
    the only thing that is computed here; the outputs stay lazy.
    """
    check(plan)
    made = populations(cdm, plan)
    out, enough = {}, set()
    for name, spec in plan.outputs.items():
        of = spec.get("population", "base")
        if policy is not None and of not in enough:
            assert_min_persons(made[of], policy, "subject_id")
            enough.add(of)
        out[name] = OUTPUTS[spec["kind"]](cdm, made[of], spec)
    return out


def preview(plan: Plan) -> list[dict]:
    """What a plan would make: kind and population of each output."""
    check(plan)
    return [{"output": name, "kind": spec["kind"], "population": spec.get("population", "base")} for name, spec in plan.outputs.items()]
