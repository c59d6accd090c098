"""Registered queries over sessions, plans, releases, scores and the further population analyses, with SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import cohorts, concepts, features, filters, gate, noise, profile, survival, temporal, verbs
from ..operators.gate import Policy
from ..session import Session
from ..sources.cdm import Cdm
from . import analyses, outputs, population, scores, standard
from .clinical import _EV, _FIRST, _T, Built, _days_as_text, _episodes, _measured
from .outputs import Plan

EPISODE = "subject_id, CAST(cohort_start_date AS VARCHAR) AS cohort_start_date, CAST(cohort_end_date AS VARCHAR) AS cohort_end_date"
PERIOD = "JOIN observation_period o ON o.person_id = t.subject_id AND t.cohort_start_date BETWEEN observation_period_start_date AND observation_period_end_date"
PROC = _EV["procedure"]
COND = _EV["condition"]


def _band(x: str) -> str:
    return f"CAST(floor(({x}) / 5) * 5 AS BIGINT)"


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def _open(cdm: Cdm) -> Session:
    return Session(cdm.spark, cdm, secret=b"registered", grids={"measurement.value_as_number": [0.0, 25.0, 50.0, 75.0, 100.0]})


def _comparisons(cdm: Cdm) -> DataFrame:
    made = {"eq": ("==", 1950), "ne": ("!=", 1950), "gte": (">=", 1950), "lte": ("<=", 1950), "gt": (">", 1950), "lt": ("<", 1950), "between": ("between", [1940, 1960]), "not_in": ("not_in", [1950, 1951])}
    return _union([filters.apply_filter(cdm.person, {"column": "year_of_birth", "op": op, "value": value}, public=False).agg(F.lit(name).alias("op"), F.count(F.lit(1)).alias("n")) for name, (op, value) in made.items()])


def row_queries() -> dict[str, Built]:
    """Comparisons, verbs, dates and features that have no query elsewhere."""
    eq = {"eq": "= 1950", "ne": "<> 1950", "gte": ">= 1950", "lte": "<= 1950", "gt": "> 1950", "lt": "< 1950", "between": "BETWEEN 1940 AND 1960", "not_in": "NOT IN (1950, 1951)"}
    cond = lambda cdm: cohorts.events(cdm, "condition")
    windowed = [features.Feature("had", "boolean", (2004, 2005), (-365, 0)), features.Feature("n_before", "count", None, (-730, -1)), features.Feature("n_long", "count", None, None, "event_end > date_add(event_date, 15)")]
    indexed = f"(SELECT e.*, e.event_date - t.cohort_start_date AS d FROM {COND} e JOIN {_FIRST[2]} t ON t.subject_id = e.person_id)"
    words = lambda cdm: cdm.person.select("person_id", F.when(F.col("gender_concept_id") == 8532, "female").otherwise("male").alias("sex"), (F.floor(F.col("year_of_birth") / 10) * 10).cast("string").alias("decade"))
    words_sql = "(SELECT person_id, CASE WHEN gender_concept_id = 8532 THEN 'female' ELSE 'male' END AS sex, CAST(CAST(floor(year_of_birth / 10) * 10 AS BIGINT) AS VARCHAR) AS decade FROM person)"
    how = {"any": "max(value)", "min": "min(value)", "max": "max(value)", "mean": "avg(value)", "median": "quantile_cont(value, 0.5)", "first": "arg_min(value, (event_date, event_key))", "last": "arg_max(value, (event_date, event_key))"}
    reduced = lambda cdm: _union([noise.reduce_person(_measured(cdm), "value", k, ["event_date", "event_key"]).agg(F.lit(k).alias("how"), F.count(F.lit(1)).alias("n"), F.round(F.avg("v"), 6).alias("mean")) for k in how])
    return {
        "filter_comparisons": (_comparisons, " UNION ALL ".join(f"SELECT '{k}' AS op, count(*) AS n FROM person WHERE year_of_birth {c}" for k, c in eq.items())),
        "filter_cohort_persons": (lambda cdm: filters.in_cohort(cdm.condition_occurrence, cohorts.stored(cdm, 2)).groupBy("condition_concept_id").agg(F.count(F.lit(1)).alias("n")), f"SELECT condition_concept_id, count(*) AS n FROM condition_occurrence WHERE person_id IN (SELECT subject_id FROM {_T[2]}) GROUP BY 1"),
        "filter_person_list": (lambda cdm: filters.of_concepts(cdm.condition_occurrence, "person_id", [1, 2, 3, 5, 8]).groupBy("person_id").agg(F.count(F.lit(1)).alias("n")), "SELECT person_id, count(*) AS n FROM condition_occurrence WHERE person_id IN (1, 2, 3, 5, 8) GROUP BY 1"),
        "temporal_dates_relative": (lambda cdm: temporal.handle_dates(temporal.index_window(cond(cdm), cohorts.stored(cdm, 2)).select("event_key", "event_date", "event_end", F.col("cohort_start_date").alias("ix")), "relative", index="ix").select("event_key", "event_date", "event_end"), f"SELECT event_key, event_date - cohort_start_date AS event_date, event_end - cohort_start_date AS event_end FROM {COND} e JOIN {_T[2]} t ON t.subject_id = e.person_id"),
        "temporal_dates_removed": (lambda cdm: temporal.handle_dates(cdm.drug_exposure.select("drug_concept_id", "drug_exposure_start_date", "quantity"), "remove").groupBy("drug_concept_id").agg(F.count(F.lit(1)).alias("n")), "SELECT drug_concept_id, count(*) AS n FROM drug_exposure GROUP BY 1"),
        "temporal_dates_absolute": (lambda cdm: _days_as_text(temporal.handle_dates(cdm.death, "absolute")).select("person_id", "death_date"), "SELECT person_id, CAST(death_date AS VARCHAR) AS death_date FROM death"),
        "temporal_observed_once": (lambda cdm: _days_as_text(temporal.observed_once(cohorts.stored(cdm, 3), cdm.observation_period)), f"SELECT t.subject_id, CAST(t.cohort_start_date AS VARCHAR) AS cohort_start_date, CAST(t.cohort_end_date AS VARCHAR) AS cohort_end_date, CAST(min(observation_period_start_date) AS VARCHAR) AS obs_start, CAST(max(observation_period_end_date) AS VARCHAR) AS obs_end FROM {_T[3]} t {PERIOD} GROUP BY ALL HAVING count(*) = 1"),
        "features_windowed": (lambda cdm: features.features(temporal.index_window(outputs.measured(cdm, "condition"), cohorts.first_episode(cohorts.stored(cdm, 2))), cohorts.stored(cdm, 2).withColumnRenamed("subject_id", "person_id"), windowed), f"SELECT r.person_id, coalesce(max(CASE WHEN concept_id IN (2004, 2005) AND d BETWEEN -365 AND 0 THEN 1 ELSE 0 END), 0) AS had, count(*) FILTER (d BETWEEN -730 AND -1) AS n_before, count(*) FILTER (event_end > event_date + 15) AS n_long FROM (SELECT DISTINCT subject_id AS person_id FROM {_T[2]}) r LEFT JOIN {indexed} e ON e.person_id = r.person_id GROUP BY 1"),
        "features_by_episode": (lambda cdm: _days_as_text(outputs.OUTPUTS["episode_features"](cdm, cohorts.stored(cdm, 2), {"domain": "condition", "features": windowed[:2]})), f"SELECT t.subject_id AS person_id, CAST(t.cohort_start_date AS VARCHAR) AS cohort_start_date, CAST(t.cohort_end_date AS VARCHAR) AS cohort_end_date, coalesce(max(CASE WHEN concept_id IN (2004, 2005) AND event_date - cohort_start_date BETWEEN -365 AND 0 THEN 1 ELSE 0 END), 0) AS had, count(*) FILTER (event_date - cohort_start_date BETWEEN -730 AND -1) AS n_before FROM {_T[2]} t LEFT JOIN {COND} e ON e.person_id = t.subject_id GROUP BY ALL"),
        "features_drug_duration": (lambda cdm: features.features(outputs.measured(cdm, "drug"), cdm.person, [features.Feature(f"days_{k}", "drug_duration", None, stat=k) for k in ("mean", "sum", "max")]).where("days_sum IS NOT NULL").select("person_id", F.round("days_mean", 6).alias("days_mean"), "days_sum", "days_max"), "SELECT person_id, round(avg(drug_exposure_end_date - drug_exposure_start_date), 6) AS days_mean, CAST(sum(drug_exposure_end_date - drug_exposure_start_date) AS BIGINT) AS days_sum, max(drug_exposure_end_date - drug_exposure_start_date) AS days_max FROM drug_exposure JOIN person USING (person_id) GROUP BY 1"),
        "verb_filter": (lambda cdm: verbs.filter_rows(words(cdm), "sex", "==", "female").groupBy("decade").agg(F.count(F.lit(1)).alias("n")), f"SELECT decade, count(*) AS n FROM {words_sql} WHERE sex = 'female' GROUP BY 1"),
        "verb_select": (lambda cdm: verbs.select_columns(words(cdm), ["decade"]), f"SELECT person_id, decade FROM {words_sql}"),
        "verb_merge": (lambda cdm: verbs.merge(words(cdm), cdm.condition_occurrence.select("person_id", "condition_concept_id"), how="left").groupBy("sex", "condition_concept_id").agg(F.count(F.lit(1)).alias("n")), f"SELECT sex, condition_concept_id, count(*) AS n FROM {words_sql} LEFT JOIN condition_occurrence USING (person_id) GROUP BY ALL"),
        "verb_bind": (lambda cdm: verbs.bind_rows([words(cdm), words(cdm).where("sex = 'male'")]).groupBy("sex").agg(F.count(F.lit(1)).alias("n")), f"SELECT sex, CASE WHEN sex = 'male' THEN 2 ELSE 1 END * count(*) AS n FROM {words_sql} GROUP BY sex"),
        "verb_recode": (lambda cdm: verbs.recode(words(cdm), "decade", ["1940", "1950"], "other").groupBy("decade").agg(F.count(F.lit(1)).alias("n")), f"SELECT CASE WHEN decade IN ('1940', '1950') THEN decade ELSE 'other' END AS decade, count(*) AS n FROM {words_sql} GROUP BY 1"),
        "verb_to_cohort": (lambda cdm: _days_as_text(verbs.to_cohort(cdm.death, cdm.observation_period)), "SELECT person_id AS subject_id, CAST(observation_period_start_date AS VARCHAR) AS cohort_start_date, CAST(observation_period_end_date AS VARCHAR) AS cohort_end_date FROM observation_period WHERE person_id IN (SELECT person_id FROM death)"),
        "vocabulary_lookup": (lambda cdm: concepts.lookup(cdm, [2001, 8507, 99]).select("concept_id", "concept_name", "domain_id"), "SELECT concept_id, concept_name, domain_id FROM concept WHERE concept_id IN (2001, 8507, 99)"),
        "vocabulary_page": (lambda cdm: concepts.browse(cdm, 5, 10, domain_id="Condition")[1].select("concept_id", "concept_name"), "SELECT concept_id, concept_name FROM concept WHERE domain_id = 'Condition' ORDER BY concept_id LIMIT 10 OFFSET 5"),
        "cohort_of_persons": (lambda cdm: _days_as_text(cohorts.of_persons(cdm, [1, 5, 10, 20])), _episodes("SELECT DISTINCT person_id AS subject_id, observation_period_start_date AS cohort_start_date, observation_period_end_date AS cohort_end_date FROM observation_period WHERE person_id IN (1, 5, 10, 20)")),
        "cohort_everyone": (lambda cdm: _days_as_text(cohorts.everyone(cdm)), _episodes("SELECT DISTINCT person_id AS subject_id, observation_period_start_date AS cohort_start_date, observation_period_end_date AS cohort_end_date FROM observation_period")),
        "noise_count_persons": (lambda cdm: noise.count_persons(cdm.condition_occurrence), "SELECT count(DISTINCT person_id) AS value FROM condition_occurrence"),
        "noise_numeric_bins": (lambda cdm: noise.numeric_histogram(cdm.measurement, "value_as_number", [0.0, 20.0, 40.0, 60.0]), "SELECT CAST(k AS BIGINT) AS bin, count(v) AS value FROM range(3) b(k) LEFT JOIN (SELECT greatest(least(avg(value_as_number), 60), 0) AS v FROM measurement WHERE value_as_number IS NOT NULL GROUP BY person_id) m ON least(floor(v / 20), 2) = k GROUP BY k"),
        "noise_date_bins": (lambda cdm: noise.date_histogram(cdm.condition_occurrence, "condition_start_date", ["1995-01-01", "1996-01-01", "1998-01-01", "2002-01-01"]), "SELECT CAST(k AS BIGINT) AS bin, count(d) AS value FROM range(3) b(k) LEFT JOIN (SELECT greatest(least(min(condition_start_date), DATE '2002-01-01'), DATE '1995-01-01') AS d FROM condition_occurrence GROUP BY person_id) m ON k = CASE WHEN d < DATE '1996-01-01' THEN 0 WHEN d < DATE '1998-01-01' THEN 1 ELSE 2 END GROUP BY k"),
        "temporal_spec": (lambda cdm: _days_as_text(temporal.by_spec(cond(cdm), cohorts.stored(cdm, 2), {"index_window": (-365, 365), "calendar": ("1995-06-01", "2000-12-31"), "event_select": {"order": "first", "n": 1}})).select("person_id", "event_date", "event_key"), f"SELECT person_id, CAST(event_date AS VARCHAR) AS event_date, event_key FROM (SELECT e.*, row_number() OVER (PARTITION BY person_id ORDER BY event_date, event_key) AS k FROM {COND} e JOIN {_T[2]} t ON t.subject_id = e.person_id WHERE event_date - cohort_start_date BETWEEN -365 AND 365 AND event_date BETWEEN DATE '1995-06-01' AND DATE '2000-12-31') WHERE k = 1"),
        "noise_binary_rate": (lambda cdm: noise.binary_rate(cdm.measurement.withColumn("high", F.when(F.col("value_as_number").isNotNull(), (F.col("value_as_number") > 95).cast("int"))), "high"), "SELECT count(*) FILTER (v = 1) AS numerator, count(*) AS denominator FROM (SELECT max(CASE WHEN value_as_number > 95 THEN 1 ELSE 0 END) AS v FROM measurement WHERE value_as_number IS NOT NULL GROUP BY person_id)"),
        "noise_reducers": (reduced, " UNION ALL ".join(f"SELECT '{k}' AS how, count(*) AS n, round(avg(v), 6) AS mean FROM (SELECT {a} AS v FROM {_EV['measurement']} WHERE value IS NOT NULL GROUP BY person_id)" for k, a in how.items())),
    }


def release_queries() -> dict[str, Built]:
    """Gated results: what leaves a session."""
    policy = Policy()
    strict = Policy(tab=20, band=10)
    by_concept = "SELECT condition_concept_id, count(DISTINCT person_id) AS n_persons, count(*) AS n_records FROM condition_occurrence GROUP BY 1"
    counted = lambda cdm: cdm.condition_occurrence.groupBy("condition_concept_id").agg(F.countDistinct("person_id").alias("n_persons"), F.count(F.lit(1)).alias("n_records"))
    ratio = lambda cdm: cdm.condition_occurrence.groupBy("condition_concept_id").agg(F.countDistinct("person_id").alias("n_persons"), F.countDistinct(F.when(F.col("condition_end_date").isNull(), F.col("person_id"))).alias("n_open")).withColumn("share", F.col("n_open") / F.col("n_persons"))
    ages = lambda cdm: cdm.person.select("person_id", (1995 - F.col("year_of_birth")).alias("age"))
    return {
        "gate_person": (lambda cdm: gate.gate(counted(cdm).drop("n_records"), "person", ["n_persons"], strict), f"SELECT condition_concept_id, CAST(floor(n_persons / 10) * 10 AS BIGINT) AS n_persons FROM ({by_concept}) WHERE n_persons >= 20"),
        "gate_record": (lambda cdm: gate.gate(counted(cdm), "record", ["n_records"], strict, companion="n_persons"), f"SELECT condition_concept_id, CAST(floor(n_persons / 10) * 10 AS BIGINT) AS n_persons, CAST(floor(n_records / 10) * 10 AS BIGINT) AS n_records FROM ({by_concept}) WHERE n_persons >= 20 AND n_records >= 20"),
        "gate_ratio": (lambda cdm: gate.gate(ratio(cdm), "person", ["n_open", "n_persons"], policy, ratios={"share": ("n_open", "n_persons")}).withColumn("share", F.round("share", 6)), f"SELECT condition_concept_id, {_band('n')} AS n_persons, {_band('m')} AS n_open, CASE WHEN {_band('m')} > 0 AND {_band('n')} > 0 THEN round({_band('m')} / {_band('n')}, 6) END AS share FROM (SELECT condition_concept_id, count(DISTINCT person_id) AS n, count(DISTINCT CASE WHEN condition_end_date IS NULL THEN person_id END) AS m FROM condition_occurrence GROUP BY 1) WHERE n >= 3 AND m >= 3"),
        "gate_top_n": (lambda cdm: gate.banded_top_n(counted(cdm), 5, "n_persons", ["condition_concept_id"]), f"SELECT * FROM ({by_concept}) ORDER BY floor(n_persons / 5) DESC, condition_concept_id LIMIT 5"),
        "gate_age_bands": (lambda cdm: gate.age_bands(ages(cdm)).groupBy("age_group").agg(F.count(F.lit(1)).alias("n")), "SELECT CASE WHEN n >= 3 AND low >= 0 THEN low || '-' || (low + 4) END AS age_group, CAST(sum(n) AS BIGINT) AS n FROM (SELECT CAST(floor((1995 - year_of_birth) / 5) * 5 AS BIGINT) AS low, count(*) AS n FROM person GROUP BY 1) GROUP BY 1"),
        "profile_monthly": (lambda cdm: profile.monthly(cdm.condition_occurrence, "condition_start_date"), "SELECT year(condition_start_date) * 100 + month(condition_start_date) AS month, count(*) AS n_records, count(DISTINCT person_id) AS n_persons FROM condition_occurrence GROUP BY 1"),
        "profile_top_values": (lambda cdm: profile.top_values(cdm.condition_occurrence, "condition_concept_id", 5, policy), f"SELECT condition_concept_id AS value, n_records, n_persons FROM ({by_concept}) WHERE n_persons >= 3 ORDER BY floor(n_persons / 5) DESC, value LIMIT 5"),
        "profile_numeric_range": (lambda cdm: profile.numeric_range(cdm.measurement, "value_as_number", policy), "SELECT round(max(CASE WHEN k = greatest(least(CAST(floor((n - 1) * 0.05) AS BIGINT), n - 4), 3) THEN v END), 6) AS p05, round(max(CASE WHEN k = least(greatest(CAST(floor((n - 1) * 0.95) AS BIGINT), 3), n - 4) THEN v END), 6) AS p95 FROM (SELECT v, row_number() OVER (ORDER BY v) - 1 AS k, count(*) OVER () AS n FROM (SELECT avg(value_as_number) AS v FROM measurement WHERE value_as_number IS NOT NULL GROUP BY person_id))"),
        "profile_crosstab_strata": (lambda cdm: profile.crosstab(cdm.visit_occurrence.join(cdm.person, "person_id"), "visit_concept_id", "gender_concept_id", strata="visit_type_concept_id"), "WITH v AS (SELECT v.person_id, visit_concept_id AS r, gender_concept_id AS c, visit_type_concept_id AS s FROM visit_occurrence v JOIN person USING (person_id)) SELECT r AS \"row\", c AS col, s AS stratum, count(DISTINCT v.person_id) AS n_persons FROM (SELECT DISTINCT r FROM v) CROSS JOIN (SELECT DISTINCT c FROM v) CROSS JOIN (SELECT DISTINCT s FROM v) LEFT JOIN v USING (r, c, s) GROUP BY ALL"),
        "session_table_stats": (lambda cdm: _open(cdm).table_stats("condition_occurrence"), f"SELECT {_band('count(*)')} AS n_records, {_band('count(DISTINCT person_id)')} AS n_persons FROM condition_occurrence"),
        "session_column_stats": (lambda cdm: _open(cdm).column_stats("condition_occurrence", ["condition_concept_id", "condition_end_date"]), " UNION ALL ".join(f"SELECT {_band('count(*)')} AS n_total, '{c}' AS column_name, {_band(f'count(*) - count({c})')} AS n_missing, count(DISTINCT {c}) AS n_distinct, {_band(f'count(DISTINCT CASE WHEN {c} IS NOT NULL THEN person_id END)')} AS n_persons FROM condition_occurrence" for c in ("condition_concept_id", "condition_end_date"))),
        "session_domain_coverage": (lambda cdm: _open(cdm).domain_coverage(["condition_occurrence", "death", "concept"]), " UNION ALL ".join(f"SELECT {_band('count(DISTINCT person_id)')} AS n_persons, '{t}' AS table_name FROM {t}" for t in ("condition_occurrence", "death"))),
        "session_value_counts": (lambda cdm: _open(cdm).value_counts("visit_occurrence", "visit_concept_id", 3), f"SELECT value, {_band('n_records')} AS n_records, {_band('n_persons')} AS n_persons FROM (SELECT visit_concept_id AS value, count(*) AS n_records, count(DISTINCT person_id) AS n_persons FROM visit_occurrence GROUP BY 1 ORDER BY floor(n_persons / 5) DESC, value LIMIT 3)"),
        "session_concept_prevalence": (lambda cdm: _open(cdm).concept_prevalence("condition_occurrence", limit=10), f"SELECT concept_id, concept_name, {_band('n_persons')} AS n_persons, {_band('n_records')} AS n_records FROM (SELECT condition_concept_id AS concept_id, count(DISTINCT person_id) AS n_persons, count(*) AS n_records FROM condition_occurrence GROUP BY 1 HAVING count(DISTINCT person_id) >= 3 ORDER BY floor(n_persons / 5) DESC, concept_id LIMIT 10) LEFT JOIN concept USING (concept_id)"),
        "session_date_counts": (lambda cdm: _open(cdm).date_counts("condition_occurrence", "quarter"), f"SELECT year(condition_start_date) || '-Q' || quarter(condition_start_date) AS period, {_band('count(*)')} AS n_records, {_band('count(DISTINCT person_id)')} AS n_persons FROM condition_occurrence GROUP BY 1 HAVING count(DISTINCT person_id) >= 3"),
        "session_histogram": (lambda cdm: _open(cdm).numeric_histogram("measurement", "value_as_number", breaks=[0.0, 25.0, 50.0, 75.0, 100.0]), f"SELECT CAST(least(floor(value_as_number / 25), 3) AS BIGINT) AS bin, {_band('count(*)')} AS n_records, {_band('count(DISTINCT person_id)')} AS n_persons FROM measurement WHERE value_as_number BETWEEN 0 AND 100 GROUP BY 1 HAVING count(DISTINCT person_id) >= 3"),
        "session_locate": (lambda cdm: _open(cdm).locate_concept([2003, 5001, 8532]), " UNION ALL ".join(f"SELECT '{t}' AS table_name, '{c}' AS column_name, {c} AS concept_id, {_band('count(*)')} AS n_records, {_band('count(DISTINCT person_id)')} AS n_persons FROM {t} WHERE {c} IN (2003, 5001, 8532) GROUP BY {c} HAVING count(DISTINCT person_id) >= 3" for t, c in (("person", "gender_concept_id"), ("condition_occurrence", "condition_concept_id"), ("procedure_occurrence", "procedure_concept_id"), ("death", "cause_concept_id"), ("condition_era", "condition_concept_id")))),
        "session_cohort_list": (lambda cdm: _open(cdm).cohort_list(), f"SELECT cohort_definition_id, {_band('count(*)')} AS entries, {_band('count(DISTINCT subject_id)')} AS subjects FROM cohort GROUP BY 1 HAVING count(DISTINCT subject_id) >= 3"),
        "session_template": (lambda cdm: _open(cdm).query_exec("visit.type_summary"), f"SELECT visit_concept_id AS concept_id, concept_name, {_band('n_persons')} AS n_persons, {_band('n_records')} AS n_records FROM (SELECT visit_concept_id, count(DISTINCT person_id) AS n_persons, count(*) AS n_records FROM visit_occurrence GROUP BY 1) JOIN concept ON concept_id = visit_concept_id WHERE n_persons >= 3 AND n_records >= 3"),
        "session_analysis": (lambda cdm: _open(cdm).analysis_run("fe.prevalence", 1, start=-365, end=-1), f"SELECT concept_id, {_band('count(DISTINCT subject_id)')} AS n_subjects FROM {_T[1]} t JOIN {COND} e ON e.person_id = t.subject_id WHERE event_date - cohort_start_date BETWEEN -365 AND -1 AND concept_id <> 0 GROUP BY 1 HAVING count(DISTINCT subject_id) >= 3"),
        "session_incidence": (lambda cdm: _open(cdm).analysis_run("incidence.rate", 2).withColumn("proportion", F.round("proportion", 6)), f"SELECT {_band('n')} AS n_persons, {_band('m')} AS n_with_outcome, CASE WHEN {_band('m')} > 0 THEN round({_band('m')} / {_band('n')}, 6) END AS proportion FROM (SELECT count(*) AS n, count(*) FILTER (k > 0) AS m FROM (SELECT a.subject_id, count(o.cohort_start_date) AS k FROM {_ARM.format(first=_FIRST[2])} a LEFT JOIN {_T[1]} o ON o.subject_id = a.subject_id AND o.cohort_start_date BETWEEN a.cohort_start_date AND risk_end WHERE risk_end >= a.cohort_start_date GROUP BY a.subject_id)) WHERE n >= 3 AND m >= 3"),
        "session_standard": (lambda cdm: _open(cdm).standard_analysis(400), f"SELECT condition_concept_id AS stratum_1, {_band('count(DISTINCT person_id)')} AS count_value FROM condition_occurrence GROUP BY 1 HAVING count(DISTINCT person_id) >= 3"),
        "session_score": (lambda cdm: _open(cdm).score("chads2", 1995), f"SELECT score, {_band('count(*)')} AS n_persons FROM (SELECT CASE WHEN 1995 - year_of_birth >= 75 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS score FROM person) GROUP BY 1 HAVING count(*) >= 3"),
        "plan_membership": (lambda cdm: _days_as_text(outputs.run(cdm, Plan({"sick": {"kind": "events", "domain": "condition", "concepts": [2006, 2007]}, "treated": {"kind": "stored", "id": 2}, "both": {"kind": "combine", "op": "intersect", "members": ["sick", "treated"]}}, {"out": {"kind": "membership", "population": "both", "id": 7}}))["out"]), f"SELECT CAST(7 AS BIGINT) AS cohort_definition_id, {EPISODE} FROM (SELECT DISTINCT person_id AS subject_id, event_date AS cohort_start_date, event_end AS cohort_end_date FROM {COND} WHERE concept_id IN (2006, 2007)) WHERE subject_id IN (SELECT subject_id FROM {_T[2]})"),
        "plan_episode_wide": (lambda cdm: _days_as_text(outputs.run(cdm, Plan({"treated": {"kind": "stored", "id": 2}}, {"w": {"kind": "episode_wide", "population": "treated", "domain": "measurement", "concepts": {3001: "a", 3003: "b"}}}))["w"]), f"SELECT t.subject_id AS person_id, CAST(cohort_start_date AS VARCHAR) AS cohort_start_date, CAST(cohort_end_date AS VARCHAR) AS cohort_end_date, max(value) FILTER (concept_id = 3001) AS a, max(value) FILTER (concept_id = 3003) AS b FROM {_T[2]} t LEFT JOIN (SELECT e.*, cohort_start_date AS s, cohort_end_date AS x, row_number() OVER (PARTITION BY person_id, cohort_start_date, cohort_end_date, concept_id ORDER BY event_date, event_key) AS k FROM {_EV['measurement']} e JOIN {_T[2]} u ON u.subject_id = e.person_id) m ON m.person_id = t.subject_id AND m.s = cohort_start_date AND m.x = cohort_end_date AND k = 1 GROUP BY ALL"),
        "plan_baseline": (lambda cdm: _days_as_text(outputs.baseline(cdm, cohorts.stored(cdm, 2)).drop("age_group")), f"SELECT t.subject_id, CAST(t.cohort_start_date AS VARCHAR) AS cohort_start_date, CAST(t.cohort_end_date AS VARCHAR) AS cohort_end_date, gender_concept_id, race_concept_id, ethnicity_concept_id, CASE WHEN year(t.cohort_start_date) >= year_of_birth THEN year(t.cohort_start_date) - year_of_birth END AS age, t.cohort_start_date - obs_start AS prior_days, obs_end - t.cohort_start_date AS future_days FROM {_T[2]} t JOIN person p ON p.person_id = t.subject_id LEFT JOIN (SELECT t.subject_id, t.cohort_start_date, t.cohort_end_date, min(observation_period_start_date) AS obs_start, max(observation_period_end_date) AS obs_end FROM {_T[2]} t {PERIOD} GROUP BY ALL HAVING count(*) = 1) o USING (subject_id, cohort_start_date, cohort_end_date)"),
    }


def _frame(cdm: Cdm) -> DataFrame:
    """Scores and labels that both engines can compute."""
    return cdm.person.select(((F.col("person_id") * 37 % 101) / F.lit(101.0)).alias("score"), (F.col("person_id") * 37 % 101 + F.col("person_id") * 13 % 60 > 90).cast("long").alias("label"))


_FRAME = "(SELECT (person_id * 37 % 101) / 101.0::DOUBLE AS score, CASE WHEN person_id * 37 % 101 + person_id * 13 % 60 > 90 THEN 1 ELSE 0 END AS label FROM person)"
_ARM = "(SELECT subject_id, cohort_start_date, least(cohort_end_date, cohort_start_date + 365) AS risk_end FROM {first})"


def _arms_sql() -> str:
    """Arms 2 and 3 with outcome 1 at risk for a year: subject, start, arm, days at risk, days to the first outcome."""
    parts = [f"SELECT a.subject_id, a.cohort_start_date, {k} AS treated, risk_end - a.cohort_start_date + 1 AS days, min(o.cohort_start_date) - a.cohort_start_date AS d FROM {_ARM.format(first=_FIRST[c])} a LEFT JOIN {_T[1]} o ON o.subject_id = a.subject_id AND o.cohort_start_date BETWEEN a.cohort_start_date AND risk_end WHERE risk_end >= a.cohort_start_date GROUP BY a.subject_id, a.cohort_start_date, risk_end" for k, c in ((1, 2), (0, 3))]
    return f"({' UNION ALL '.join(parts)})"


def _ratio_sql(source: str, by: str = "") -> str:
    """The rate ratio in SQL; source has treated, time, event."""
    lead = f"{by}, " if by else ""
    sums = ", ".join(f"CAST(coalesce(sum({c}) FILTER (treated = {k}), 0) AS BIGINT) AS {n}{k}" for c, n in (("event", "events"), ("time", "days")) for k in (1, 0))
    b, se = "ln(events1 / days1) - ln(events0 / days0)", "sqrt(1 / events1 + 1 / events0)"
    shown = ", ".join(f"CASE WHEN events1 > 0 AND events0 > 0 THEN round({x}, 5) END AS {n}" for n, x in (("rr", f"exp({b})"), ("low", f"exp({b} - 1.959964 * {se})"), ("high", f"exp({b} + 1.959964 * {se})"), ("se", se)))
    return f"SELECT {lead}events1, days1, events0, days0, {shown} FROM (SELECT {lead}{sums} FROM {source} GROUP BY {by or 'ALL'})"


def _mdrr(cdm: Cdm) -> DataFrame:
    sums = population.arm_times(cohorts.stored(cdm, 2), cohorts.stored(cdm, 3), cohorts.stored(cdm, 1), 365).agg(F.sum("treated").alias("t"), F.count(F.lit(1)).alias("n"), F.sum("event").alias("d")).first()
    return cdm.spark.createDataFrame([(sums["t"], sums["n"] - sums["t"], sums["d"], analyses.mdrr(sums["t"], sums["n"] - sums["t"], sums["d"]))], "n_target long, n_comparator long, outcomes long, mdrr double").withColumn("mdrr", F.round("mdrr", 5))


def _fit(cdm: Cdm, found: dict[str, float] | None, names: tuple[str, ...]) -> DataFrame:
    return cdm.spark.createDataFrame([tuple(None if found is None else float(found[n]) for n in names)], ", ".join(f"{n} double" for n in names)).select(*[F.round(n, 5).alias(n) for n in names])


def analysis_queries() -> dict[str, Built]:
    """Effects, case series, prediction, pathways and the rest of characterisation."""
    t = {k: (lambda cdm, k=k: cohorts.stored(cdm, k)) for k in (1, 2, 3)}
    cond = lambda cdm: cohorts.events(cdm, "condition")
    proc = lambda cdm: cohorts.events(cdm, "procedure")
    arms = lambda cdm: population.arm_times(t[2](cdm), t[3](cdm), t[1](cdm), 365)
    times = f"(SELECT subject_id, cohort_start_date, treated, least(greatest(coalesce(d, days), 1), days) AS time, CASE WHEN d IS NOT NULL THEN 1 ELSE 0 END AS event FROM {_arms_sql()})"
    with_age = f"(SELECT x.*, gender_concept_id, year(cohort_start_date) - year_of_birth AS age FROM {times} x JOIN person p ON p.person_id = x.subject_id)"
    subgroup = lambda x, source=with_age: f"(SELECT *, {x} AS subgroup FROM {source})"
    had = f"CASE WHEN EXISTS (SELECT 1 FROM {COND} e WHERE e.person_id = x.subject_id AND e.concept_id IN (2004, 2005) AND e.event_date <= x.cohort_start_date) THEN 'present' ELSE 'absent' END"
    observed = f"(SELECT DISTINCT t.subject_id, t.cohort_start_date AS e FROM {_T[1]} t {PERIOD})"
    label = lambda c, lo, hi: f"(SELECT f.*, CASE WHEN EXISTS (SELECT 1 FROM {_T[1]} o WHERE o.subject_id = f.subject_id AND o.cohort_start_date - f.cohort_start_date BETWEEN {lo} AND {hi}) THEN 1 ELSE 0 END AS label FROM {c} f)"
    whole = f"(SELECT subject_id, min(cohort_start_date) AS cohort_start_date FROM (SELECT t.* FROM {_T[2]} t JOIN observation_period o ON o.person_id = t.subject_id AND observation_period_start_date <= t.cohort_start_date - 365 AND observation_period_end_date >= t.cohort_start_date + 365) GROUP BY 1)"
    clean = f"(SELECT * FROM {whole} w WHERE NOT EXISTS (SELECT 1 FROM {_T[1]} o WHERE o.subject_id = w.subject_id AND o.cohort_start_date < w.cohort_start_date))"
    layered = f"(SELECT subject_id, CAST(concept_id AS VARCHAR) AS concept_id, row_number() OVER (PARTITION BY subject_id ORDER BY event_date, concept_id) AS layer FROM (SELECT *, lag(concept_id) OVER (PARTITION BY subject_id ORDER BY event_date, concept_id) AS was FROM (SELECT DISTINCT t.subject_id, concept_id, event_date FROM {_FIRST[1]} t JOIN {PROC} e ON e.person_id = t.subject_id WHERE event_date >= t.cohort_start_date)) WHERE was IS NULL OR was <> concept_id)"
    share = lambda c, lo, hi: f"SELECT concept_id, count(DISTINCT subject_id) AS n_subjects, round(count(DISTINCT subject_id) / (SELECT count(DISTINCT subject_id) FROM {c}), 6) AS share FROM {c} t JOIN {COND} e ON e.person_id = t.subject_id WHERE event_date - cohort_start_date BETWEEN {lo} AND {hi} AND concept_id <> 0 GROUP BY 1"
    marked = label(_FIRST[2], 1, 365)
    side = lambda k: share(f"(SELECT subject_id, cohort_start_date FROM {marked} WHERE label = {k})", -365, 0)
    wash = survival.Risk(0, 730, 60)
    events_ = lambda cdm: cohorts.events(cdm, "condition", [2003, 2004, 2005]).select("person_id", F.lit(1).cast("long").alias("outcome"), "event_date")
    washed = lambda cdm: survival.survival((sets := survival.risk_sets(t[2](cdm), cdm.observation_period, cdm.death, wash)), events_(cdm), [1], wash)
    sets_sql = f"(SELECT s.*, least(cohort_end_date, obs_end, coalesce(death_date, DATE '9999-12-31'), cohort_start_date + 730) AS exit FROM (SELECT t.subject_id, t.cohort_start_date, t.cohort_end_date, min(observation_period_start_date) AS obs_start, max(observation_period_end_date) AS obs_end FROM {_T[2]} t {PERIOD} GROUP BY ALL HAVING count(*) = 1) s LEFT JOIN death d ON d.person_id = s.subject_id WHERE cohort_start_date - obs_start >= 60 AND (death_date IS NULL OR death_date >= cohort_start_date))"
    washed_ev = f"(SELECT person_id, event_date FROM (SELECT person_id, event_date, event_date - lag(event_date) OVER (PARTITION BY person_id ORDER BY event_date) AS g FROM (SELECT DISTINCT person_id, event_date FROM {COND} WHERE concept_id IN (2003, 2004, 2005))) WHERE g IS NULL OR g > 60)"
    km = f"SELECT treated, CAST(floor(coalesce(d, days - 1) / 30.4375) AS BIGINT) AS bin, count(*) AS leaving, CAST(count(d) AS BIGINT) AS events FROM {_arms_sql()} GROUP BY ALL"
    step = "(1 - events / at_risk)"
    codes = lambda cdm: cdm.concept.where("vocabulary_id = 'Source'").select("concept_id", F.concat(F.lit("C"), (F.col("concept_id") - 7000).cast("string")).alias("concept_code"))
    coded = [("a", 1, ("C0", "C1%")), ("a", 2, ("C12", "C13")), ("b", 1.5, ("C2", "C3"))]
    dist = standard.distribution_sql
    return {
        "fe_table1": (lambda cdm: analyses.table1(t[2](cdm), cdm, cond(cdm)), " UNION ALL ".join(f"SELECT '{k}' AS kind, CAST({c} AS BIGINT) AS level, count(DISTINCT subject_id) AS n_subjects FROM {_FIRST[2]} f JOIN person p ON p.person_id = f.subject_id GROUP BY ALL" for k, c in (("gender", "gender_concept_id"), ("race", "race_concept_id"), ("ethnicity", "ethnicity_concept_id"), ("age", "floor((year(cohort_start_date) - year_of_birth) / 10) * 10"))) + f" UNION ALL SELECT 'concept', concept_id, n_subjects FROM ({share(_T[2], -365, 0)})"),
        "fe_age_distribution": (lambda cdm: population.age_distribution(t[2](cdm), cdm), dist(f"SELECT floor((cohort_start_date - make_date(year_of_birth, 7, 1)) / 365) AS v FROM {_FIRST[2]} f JOIN person p ON p.person_id = f.subject_id", "v")),
        "fe_component_index": (lambda cdm: population_index(cdm, t[2](cdm)), f"SELECT subject_id, (SELECT count(DISTINCT s) FROM (VALUES (2001), (2100), (2005)) v(s) WHERE EXISTS (SELECT 1 FROM condition_occurrence c WHERE c.person_id = p.subject_id AND (c.condition_concept_id = s OR c.condition_concept_id IN (SELECT descendant_concept_id FROM concept_ancestor WHERE ancestor_concept_id = s)))) AS score FROM (SELECT DISTINCT subject_id FROM {_T[2]}) p"),
        "score_by_codes": (lambda cdm: scores.code_score(cdm, coded, codes(cdm)), "WITH e(category, weight, head, open) AS (VALUES ('a', 1.0, 'C0', false), ('a', 1.0, 'C1', true), ('a', 2.0, 'C12', false), ('a', 2.0, 'C13', false), ('b', 1.5, 'C2', false), ('b', 1.5, 'C3', false)), c AS (SELECT concept_id AS source, category, weight FROM concept JOIN e ON CASE WHEN open THEN starts_with('C' || (concept_id - 7000), head) ELSE 'C' || (concept_id - 7000) = head END WHERE vocabulary_id = 'Source'), w AS (SELECT concept_id_2 AS concept_id, category, weight FROM c JOIN concept_relationship ON concept_id_1 = source AND relationship_id = 'Maps to' AND invalid_reason IS NULL UNION ALL SELECT source, category, weight FROM c), m AS (SELECT person_id, category, max(weight) AS w FROM condition_occurrence JOIN w ON w.concept_id = condition_concept_id GROUP BY ALL) SELECT person_id, CAST(coalesce(sum(w), 0) AS DOUBLE) AS score FROM person LEFT JOIN m USING (person_id) GROUP BY 1"),
        "score_charlson": (lambda cdm: features.score(cdm, scores.CHARLSON, 1995), "SELECT person_id, 0.0::DOUBLE AS score FROM person"),
        "score_cha2ds2vasc": (lambda cdm: features.score(cdm, scores.CHA2DS2_VASC, 1995), "SELECT person_id, CAST(CASE WHEN 1995 - year_of_birth >= 75 THEN 2 WHEN 1995 - year_of_birth >= 65 THEN 1 ELSE 0 END + CASE WHEN gender_concept_id = 8532 THEN 1 ELSE 0 END AS DOUBLE) AS score FROM person"),
        "char_risk_factors": (lambda cdm: population.risk_factors(t[2](cdm), t[1](cdm), cond(cdm)), f"SELECT concept_id, p1, p2, CASE WHEN (p1 * (1 - p1) + p2 * (1 - p2)) / 2 > 0 THEN round((p1 - p2) / sqrt((p1 * (1 - p1) + p2 * (1 - p2)) / 2), 5) END AS smd FROM (SELECT concept_id, coalesce(a.share, 0) AS p1, coalesce(b.share, 0) AS p2 FROM ({side(1)}) a FULL JOIN ({side(0)}) b USING (concept_id))"),
        "cohortdx_temporal_prevalence": (lambda cdm: population.temporal_prevalence(t[1](cdm), cond(cdm), ((-365, -1), (0, 0), (1, 365))), " UNION ALL ".join(f"SELECT CAST({a} AS BIGINT) AS start_day, CAST({b} AS BIGINT) AS end_day, * FROM ({share(_T[1], a, b)})" for a, b in ((-365, -1), (0, 0), (1, 365)))),
        "cohortdx_temporal_values": (lambda cdm: population.temporal_values(cohorts.everyone(cdm), cdm, ((-30000, -1), (0, 30000))), dist("SELECT measurement_concept_id AS concept_id, CAST(a AS BIGINT) AS start_day, m.person_id, avg(value_as_number) AS v FROM measurement m JOIN observation_period o ON o.person_id = m.person_id JOIN (VALUES (-30000, -1), (0, 30000)) w(a, b) ON measurement_date - observation_period_start_date BETWEEN a AND b WHERE value_as_number IS NOT NULL GROUP BY ALL", "v", "concept_id", "start_day")),
        "cohortdx_source_concepts": (lambda cdm: population.source_concepts(cdm, concepts.ids(cdm, [2001, 2002, 2018]), "condition"), "SELECT c.condition_concept_id AS concept_id, n_records, n_subjects, concept_id_1 AS source_concept_id FROM (SELECT condition_concept_id, count(*) AS n_records, count(DISTINCT person_id) AS n_subjects FROM condition_occurrence WHERE condition_concept_id IN (2001, 2002, 2018) GROUP BY 1) c LEFT JOIN concept_relationship r ON r.concept_id_2 = c.condition_concept_id AND relationship_id = 'Maps to' AND invalid_reason IS NULL"),
        "cm_rate_ratio": (lambda cdm: population.rate_ratio(arms(cdm)), _ratio_sql(times)),
        "cm_interaction_sex": (lambda cdm: population.interaction(arms(cdm), cdm, "sex"), _ratio_sql(subgroup("CASE gender_concept_id WHEN 8507 THEN 'M' ELSE 'F' END"), "subgroup")),
        "cm_interaction_age": (lambda cdm: population.interaction(arms(cdm), cdm, "age"), _ratio_sql(subgroup("CASE WHEN age >= 60 THEN '60+' WHEN age >= 40 THEN '40+' ELSE '<40' END"), "subgroup")),
        "cm_interaction_concept": (lambda cdm: population.interaction(arms(cdm), cdm, "concept", concepts=[2004, 2005]), _ratio_sql(f"(SELECT *, {had} AS subgroup FROM {times} x)", "subgroup")),
        "cm_mdrr": (_mdrr, f"SELECT t AS n_target, n - t AS n_comparator, d AS outcomes, round(exp((1.959963984540054 + 0.8416212335729143) * sqrt(1 / (d * (t / n) * (1 - t / n)))), 5) AS mdrr FROM (SELECT CAST(sum(treated) AS BIGINT) AS t, count(*) AS n, CAST(sum(event) AS BIGINT) AS d FROM {times})"),
        "cm_cox": (lambda cdm: _fit(cdm, analyses.cox(arms(cdm)), ("hr", "low", "high")), None),
        "cm_propensity": (lambda cdm: analyses.propensity(t[2](cdm), t[3](cdm), cond(cdm)).groupBy(F.floor(F.col("preference") * 10).cast("long").alias("bin"), "label").agg(F.count(F.lit(1)).alias("n")), None),
        "kaplan_meier": (lambda cdm: analyses.kaplan_meier(analyses.survival_arms(t[2](cdm), t[3](cdm), t[1](cdm), 365)), f"SELECT treated, bin, events, at_risk, round(CASE WHEN min({step}) OVER w <= 0 THEN 0 ELSE exp(sum(ln(CASE WHEN {step} > 0 THEN {step} END)) OVER w) END, 6) AS survival FROM (SELECT treated, bin, events, CAST(sum(leaving) OVER (PARTITION BY treated ORDER BY bin DESC ROWS UNBOUNDED PRECEDING) AS BIGINT) AS at_risk FROM ({km})) WINDOW w AS (PARTITION BY treated ORDER BY bin ROWS UNBOUNDED PRECEDING)"),
        "dechallenge_rechallenge": (lambda cdm: analyses.dechallenge(t[2](cdm), t[1](cdm)), f"WITH e AS (SELECT subject_id, cohort_start_date AS s, cohort_end_date AS e FROM {_T[2]}), o AS (SELECT DISTINCT subject_id, cohort_start_date AS o FROM {_T[1]}), hit AS (SELECT subject_id, arg_min(e, (o, e)) AS e, min(o) AS o FROM e JOIN o USING (subject_id) WHERE o BETWEEN s AND e GROUP BY 1), stopped AS (SELECT * FROM hit WHERE e - o <= 30), again AS (SELECT p.subject_id, e.s, e.e FROM stopped p JOIN e ON e.subject_id = p.subject_id AND e.s > p.e), fail AS (SELECT DISTINCT subject_id FROM again JOIN o USING (subject_id) WHERE o BETWEEN s AND e) SELECT (SELECT count(*) FROM hit) AS cases, (SELECT count(*) FROM stopped) AS dechallenge, (SELECT count(DISTINCT subject_id) FROM again) AS rechallenge, (SELECT count(*) FROM fail) AS rechallenge_fail"),
        "survival_washout": (lambda cdm: _days_as_text(washed(cdm)), f"SELECT s.subject_id, CAST(s.cohort_start_date AS VARCHAR) AS cohort_start_date, CAST(s.cohort_end_date AS VARCHAR) AS cohort_end_date, CAST(1 AS BIGINT) AS outcome, CAST(CASE WHEN min(event_date) IS NOT NULL THEN 1 ELSE 0 END AS BIGINT) AS status, coalesce(min(event_date), s.exit) - s.cohort_start_date AS time FROM (SELECT * FROM {sets_sql} WHERE exit >= cohort_start_date) s LEFT JOIN {washed_ev} e ON e.person_id = s.subject_id AND event_date BETWEEN s.cohort_start_date AND s.exit GROUP BY s.subject_id, s.cohort_start_date, s.cohort_end_date, s.exit"),
        "sccs_attrition": (lambda cdm: population.series_attrition(t[2](cdm), t[1](cdm), cdm), f"SELECT CAST(0 AS BIGINT) AS step, 'outcome' AS rule, count(DISTINCT subject_id) AS cases, count(*) AS events FROM (SELECT DISTINCT subject_id, cohort_start_date FROM {_T[1]}) UNION ALL SELECT 1, 'observed', count(DISTINCT subject_id), count(*) FROM {observed} UNION ALL SELECT 2, 'exposed', count(DISTINCT subject_id), count(*) FROM {observed} WHERE subject_id IN (SELECT subject_id FROM {_T[2]})"),
        "sccs_histogram": (lambda cdm: population.series_histogram(t[2](cdm), t[1](cdm), cdm), f"SELECT CAST(floor((e - cohort_start_date) / 30) * 30 AS BIGINT) AS bin, CAST(CASE WHEN e BETWEEN cohort_start_date AND cohort_end_date THEN 1 ELSE 0 END AS BIGINT) AS exposed, count(*) AS n_events, count(DISTINCT subject_id) AS n_subjects FROM {observed} x JOIN {_FIRST[2]} f USING (subject_id) GROUP BY ALL"),
        "sccs_checks": (lambda cdm: population.series_checks(t[2](cdm), t[1](cdm), cdm), f"SELECT 'rare_outcome' AS \"check\", round((SELECT count(DISTINCT subject_id) FROM {observed}) / (SELECT count(DISTINCT person_id) FROM observation_period), 6) AS value UNION ALL SELECT 'pre_exposure_ratio', (SELECT round(CASE WHEN count(*) FILTER (d BETWEEN 1 AND 30) > 0 THEN count(*) FILTER (d BETWEEN -30 AND -1) / count(*) FILTER (d BETWEEN 1 AND 30) END, 6) FROM (SELECT e - cohort_start_date AS d FROM {observed} x JOIN {_FIRST[2]} f USING (subject_id))) UNION ALL SELECT 'monthly_trend', (SELECT round(regr_slope(n, m) / avg(n), 6) FROM (SELECT year(e) * 12 + month(e) AS m, count(*) AS n FROM {observed} GROUP BY 1))"),
        "sccs_irr": (lambda cdm: _fit(cdm, analyses.conditional_irr(analyses.case_series(t[2](cdm), t[1](cdm), cdm)), ("irr", "low", "high")), None),
        "plp_attrition": (lambda cdm: population.prediction_attrition(t[2](cdm), t[1](cdm), cdm), " UNION ALL ".join(f"SELECT CAST({k} AS BIGINT) AS step, '{n}' AS rule, count(*) AS persons, CAST(coalesce(sum(label), 0) AS BIGINT) AS outcomes FROM {label(c, 1, 365)}" for k, (n, c) in enumerate((("target", _FIRST[2]), ("observed", whole), ("no_prior_outcome", clean))))),
        "plp_covariates": (lambda cdm: population.prediction_covariates(t[2](cdm), t[1](cdm), cond(cdm), cdm), f"SELECT concept_id, CAST(label AS BIGINT) AS label, count(DISTINCT subject_id) AS n_subjects, round(count(DISTINCT subject_id) / any_value(size), 6) AS share FROM (SELECT *, count(*) OVER (PARTITION BY label) AS size FROM {label(_FIRST[2], 0, 100000)}) f JOIN {COND} e ON e.person_id = f.subject_id WHERE event_date <= cohort_start_date AND concept_id <> 0 GROUP BY ALL"),
        "plp_diagnostic": (lambda cdm: population.prediction_diagnostic(t[2](cdm), t[1](cdm), cond(cdm), cdm), f"SELECT persons, outcomes, variables, CASE WHEN persons > 0 THEN round(outcomes / persons, 6) END AS incidence, CASE WHEN variables > 0 THEN round(outcomes / variables, 6) END AS events_per_variable FROM (SELECT count(*) AS persons, CAST(coalesce(sum(label), 0) AS BIGINT) AS outcomes, (SELECT count(DISTINCT concept_id) FROM {whole} w JOIN {COND} e ON e.person_id = w.subject_id WHERE concept_id <> 0 AND event_date - cohort_start_date BETWEEN -365 AND 0) AS variables FROM {label(whole, 1, 365)})"),
        "plp_model": (lambda cdm: _fit(cdm, {"mean": (r := population.prediction_model(t[2](cdm), t[1](cdm), cond(cdm), cdm).agg(F.avg("score").alias("m"), F.avg("label").alias("l")).first())["m"], "label": r["l"]}, ("mean", "label")), f"SELECT round(avg(label), 5) AS mean, round(avg(label), 5) AS label FROM {label(whole, 1, 365)}"),
        "plp_auroc": (lambda cdm: analyses.auroc(_frame(cdm)), f"SELECT round((sum(CASE WHEN label = 1 THEN r END) - p * (p + 1) / 2) / (p * (n - p)), 6) AS auroc FROM (SELECT label, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2 AS r, sum(label) OVER () AS p, count(*) OVER () AS n FROM {_FRAME}) GROUP BY p, n"),
        "plp_auprc": (lambda cdm: analyses.auprc(_frame(cdm)), f"SELECT round(sum(k / total * (coalesce(lag, precision) + precision) / 2), 6) AS auprc FROM (SELECT k, total, precision, lag(precision) OVER (ORDER BY score DESC) AS lag FROM (SELECT score, k, sum(k) OVER () AS total, sum(k) OVER (ORDER BY score DESC) / sum(n) OVER (ORDER BY score DESC) AS precision FROM (SELECT score, sum(label) AS k, count(*) AS n FROM {_FRAME} GROUP BY 1)))"),
        "plp_calibration": (lambda cdm: analyses.calibration(_frame(cdm)), f"SELECT CAST(b AS BIGINT) AS bin, count(*) AS n, round(avg(score), 6) AS mean_predicted, round(avg(label), 6) AS observed FROM (SELECT score, label, len(list_filter(q, lambda x: x < score)) AS b FROM {_FRAME}, (SELECT quantile_cont(score, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS q FROM {_FRAME})) GROUP BY 1"),
        "plp_thresholds": (lambda cdm: analyses.thresholds(_frame(cdm)), f"SELECT k / 10.0::DOUBLE AS threshold, count(*) FILTER (score >= k / 10.0 AND label = 1) AS tp, count(*) FILTER (score >= k / 10.0 AND label = 0) AS fp, count(*) FILTER (score < k / 10.0 AND label = 1) AS fn, count(*) FILTER (score < k / 10.0 AND label = 0) AS tn FROM {_FRAME}, range(1, 10) r(k) GROUP BY k"),
        "txpath_duration_eras": (lambda cdm: population.duration_eras(t[1](cdm), cohorts.events(cdm, "condition")), dist(f"SELECT concept_id, subject_id, avg(event_end - event_date) AS v FROM {_FIRST[1]} t JOIN {COND} e ON e.person_id = t.subject_id WHERE event_date >= t.cohort_start_date GROUP BY ALL", "v", "concept_id")),
        "txpath_gated": (lambda cdm: population.gated_pathways(analyses.pathways(t[1](cdm), proc(cdm)), 3, 3), None),
        "txpath_layers": (lambda cdm: analyses.pathways(t[1](cdm), proc(cdm)).select(F.size(F.split("path", ">")).cast("long").alias("layers"), "n_subjects").groupBy("layers").agg(F.sum("n_subjects").alias("n_subjects")), f"SELECT least(layers, 5) AS layers, count(*) AS n_subjects FROM (SELECT subject_id, count(*) AS layers FROM {layered} GROUP BY 1) GROUP BY 1"),
    }


def population_index(cdm: Cdm, persons: DataFrame) -> DataFrame:
    """The component index over seeds that the views have."""
    return scores.component_index(cdm, persons, (2001, 2100, 2005))


def catalog() -> dict[str, Built]:
    """All of them by name."""
    return {**row_queries(), **release_queries(), **analysis_queries()}
