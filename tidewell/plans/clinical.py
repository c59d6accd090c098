"""Registered queries over the row, cohort, feature, survival, profile, vocabulary and analysis operators, with SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import cohorts, concepts, features, filters, gate, noise, profile, survival, temporal
from ..sources.cdm import Cdm
from . import analyses, standard

Built = tuple[Callable[[Cdm], DataFrame], str | None]
_T = {k: f"(SELECT DISTINCT subject_id, cohort_start_date, cohort_end_date FROM cohort WHERE cohort_definition_id = {k})" for k in (1, 2, 3)}
_FIRST = {k: f"(SELECT subject_id, min(cohort_start_date) AS cohort_start_date, arg_min(cohort_end_date, (cohort_start_date, cohort_end_date)) AS cohort_end_date FROM {t} GROUP BY subject_id)" for k, t in _T.items()}
_EV = {
    "condition": "(SELECT person_id, condition_concept_id AS concept_id, condition_start_date AS event_date, coalesce(condition_end_date, condition_start_date) AS event_end, condition_occurrence_id AS event_key FROM condition_occurrence)",
    "measurement": "(SELECT person_id, measurement_concept_id AS concept_id, measurement_date AS event_date, measurement_date AS event_end, measurement_id AS event_key, value_as_number AS value, range_low, range_high FROM measurement)",
    "procedure": "(SELECT person_id, procedure_concept_id AS concept_id, procedure_date AS event_date, procedure_date AS event_end, procedure_occurrence_id AS event_key FROM procedure_occurrence)",
}
_TEXT = {"cohort_start_date": "CAST(cohort_start_date AS VARCHAR) AS cohort_start_date", "cohort_end_date": "CAST(cohort_end_date AS VARCHAR) AS cohort_end_date"}


def _days_as_text(df: DataFrame) -> DataFrame:
    """Dates as ISO text, so that both engines give the same type."""
    return df.select(*[F.date_format(c, "yyyy-MM-dd").alias(c) if t == "date" else F.col(c) for c, t in df.dtypes])


def _measured(cdm: Cdm) -> DataFrame:
    return cdm.measurement.select("person_id", F.col("measurement_concept_id").alias("concept_id"), F.col("measurement_date").alias("event_date"), F.col("measurement_date").alias("event_end"), F.col("measurement_id").alias("event_key"), F.col("value_as_number").alias("value"), "range_low", "range_high")


def _episodes(sql: str) -> str:
    return f"SELECT subject_id, {_TEXT['cohort_start_date']}, {_TEXT['cohort_end_date']} FROM ({sql})"


def row_operators() -> dict[str, Built]:
    """Filters and time-anchored row operators."""
    tree = {"op": "and", "filters": [{"column": "condition_concept_id", "op": "in", "value": [2001, 2002, 2003, 2004]}, {"op": "or", "filters": [{"column": "condition_end_date", "op": "is_null"}, {"column": "condition_start_date", "op": "between", "value": ["1996-01-01", "1997-12-31"]}]}, {"column": "condition_type_concept_id", "op": "not_in", "value": [32818]}]}
    cond = lambda cdm: cohorts.events(cdm, "condition")
    gap_sql = f"SELECT *, sum(fresh) OVER (PARTITION BY person_id, concept_id ORDER BY event_date, event_key ROWS UNBOUNDED PRECEDING) AS chain FROM (SELECT *, CASE WHEN event_date - lag(event_date) OVER (PARTITION BY person_id, concept_id ORDER BY event_date, event_key) <= 90 THEN 0 ELSE 1 END AS fresh FROM {_EV['condition']})"
    rows = "person_id, concept_id, CAST(event_date AS VARCHAR) AS event_date, CAST(event_end AS VARCHAR) AS event_end, event_key"
    observed = f"(SELECT t.subject_id, t.cohort_start_date, t.cohort_end_date, min(observation_period_start_date) AS obs_start, max(observation_period_end_date) AS obs_end FROM {_T[1]} t JOIN observation_period o ON o.person_id = t.subject_id AND t.cohort_start_date BETWEEN observation_period_start_date AND observation_period_end_date GROUP BY ALL HAVING count(*) = 1)"
    interval = f"SELECT e.*, t.cohort_start_date, t.cohort_end_date FROM {_EV['condition']} e JOIN {_T[2]} t ON t.subject_id = e.person_id"
    return {
        "filter_tree": (lambda cdm: _days_as_text(filters.apply_filter(cdm.condition_occurrence, tree)).select("condition_occurrence_id", "person_id", "condition_concept_id", "condition_start_date"), "SELECT condition_occurrence_id, person_id, condition_concept_id, CAST(condition_start_date AS VARCHAR) AS condition_start_date FROM condition_occurrence WHERE condition_concept_id IN (2001, 2002, 2003, 2004) AND (condition_end_date IS NULL OR condition_start_date BETWEEN DATE '1996-01-01' AND DATE '1997-12-31') AND condition_type_concept_id NOT IN (32818)"),
        "filter_value_bin": (lambda cdm: filters.apply_filter(cdm.measurement, {"column": "value_as_number", "op": "value_bin", "value": [10, 20]}).groupBy("measurement_concept_id").agg(F.count(F.lit(1)).alias("n")), "SELECT measurement_concept_id, count(*) AS n FROM measurement WHERE value_as_number >= 10 AND value_as_number < 20 GROUP BY ALL"),
        "filter_during_visits": (lambda cdm: filters.during_visits(cdm.procedure_occurrence, cdm.visit_occurrence, [9201, 9203]).groupBy("procedure_concept_id").agg(F.count(F.lit(1)).alias("n")), "SELECT procedure_concept_id, count(*) AS n FROM procedure_occurrence WHERE visit_occurrence_id IN (SELECT visit_occurrence_id FROM visit_occurrence WHERE visit_concept_id IN (9201, 9203)) GROUP BY ALL"),
        "filter_time_window": (lambda cdm: filters.time_window(cdm.drug_exposure, "drug_exposure_start_date", "1997-03-01", "1997-06-30").groupBy("drug_concept_id").agg(F.count(F.lit(1)).alias("n")), "SELECT drug_concept_id, count(*) AS n FROM drug_exposure WHERE drug_exposure_start_date BETWEEN DATE '1997-03-01' AND DATE '1997-06-30' GROUP BY ALL"),
        "temporal_index_window": (lambda cdm: temporal.index_window(cond(cdm), cohorts.stored(cdm, 2), -180, 180).groupBy("concept_id", "days_from_index").agg(F.count(F.lit(1)).alias("n")), f"SELECT concept_id, event_date - cohort_start_date AS days_from_index, count(*) AS n FROM {_EV['condition']} e JOIN {_T[2]} t ON t.subject_id = e.person_id WHERE event_date - cohort_start_date BETWEEN -180 AND 180 GROUP BY ALL"),
        "temporal_event_select_last": (lambda cdm: _days_as_text(temporal.event_select(cond(cdm), ["person_id"], 2, last=True)), f"SELECT {rows} FROM (SELECT *, row_number() OVER (PARTITION BY person_id ORDER BY event_date DESC, event_key) AS k FROM {_EV['condition']}) WHERE k <= 2"),
        "temporal_event_select_first": (lambda cdm: _days_as_text(temporal.event_select(cond(cdm), ["person_id", "concept_id"])), f"SELECT {rows} FROM (SELECT *, row_number() OVER (PARTITION BY person_id, concept_id ORDER BY event_date, event_key) AS k FROM {_EV['condition']}) WHERE k = 1"),
        "temporal_min_gap": (lambda cdm: _days_as_text(temporal.min_gap(cond(cdm), ["person_id", "concept_id"], 90)), f"SELECT {rows} FROM (SELECT *, row_number() OVER (PARTITION BY person_id, concept_id, chain ORDER BY event_date, event_key) AS k FROM ({gap_sql})) WHERE k = 1"),
        "temporal_min_gap_last": (lambda cdm: _days_as_text(temporal.min_gap(cond(cdm), ["person_id", "concept_id"], 90, last=True)), f"SELECT {rows} FROM (SELECT *, row_number() OVER (PARTITION BY person_id, concept_id, chain ORDER BY event_date DESC, event_key DESC) AS k FROM ({gap_sql})) WHERE k = 1"),
        "temporal_dates_binned": (lambda cdm: temporal.handle_dates(cdm.condition_occurrence.select("condition_concept_id", "condition_start_date"), "binned", unit="week").groupBy("condition_start_date").agg(F.count(F.lit(1)).alias("n")), "SELECT strftime(date_trunc('week', condition_start_date), '%Y-%m-%d') AS condition_start_date, count(*) AS n FROM condition_occurrence GROUP BY ALL"),
        "temporal_covariates": (lambda cdm: _days_as_text(temporal.temporal_covariates(cond(cdm), cohorts.stored(cdm, 1), cdm.observation_period, -365, 0, 30)), f"SELECT t.subject_id, {', '.join(_TEXT.values())}, concept_id, CAST(floor((event_date - cohort_start_date + 365) / 30) + 1 AS BIGINT) AS bin, 1 AS present, count(*) AS n_records FROM {observed} t JOIN {_EV['condition']} e ON e.person_id = t.subject_id WHERE event_date BETWEEN obs_start AND obs_end AND event_date - cohort_start_date BETWEEN -365 AND 0 GROUP BY ALL"),
        "temporal_person_period": (lambda cdm: _days_as_text(temporal.person_period(cohorts.stored(cdm, 2), cdm.observation_period, -90, 89, 30)), f"SELECT subject_id, {', '.join(_TEXT.values())}, bin, CAST(bin_start AS VARCHAR) AS bin_start, CAST(bin_end AS VARCHAR) AS bin_end, bin_end - bin_start + 1 AS days_observed FROM (SELECT subject_id, cohort_start_date, cohort_end_date, bin, greatest(cohort_start_date + CAST(-90 + (bin - 1) * 30 AS INTEGER), obs_start) AS bin_start, least(cohort_start_date + CAST(least(-90 + bin * 30 - 1, 89) AS INTEGER), obs_end) AS bin_end FROM {observed.replace(_T[1], _T[2])} CROSS JOIN (SELECT unnest(range(1, 7)) AS bin)) WHERE bin_start <= bin_end"),
        "temporal_intervals_overlap": (lambda cdm: _days_as_text(temporal.intervals(cond(cdm), cohorts.stored(cdm, 2))), f"SELECT {rows}, {', '.join(_TEXT.values())} FROM ({interval}) WHERE event_date <= cohort_end_date AND event_end >= cohort_start_date"),
        "temporal_intervals_nearest": (lambda cdm: _days_as_text(temporal.intervals(cond(cdm), cohorts.stored(cdm, 2), "starts_in", (-365, 365), "nearest")), f"SELECT {rows}, {', '.join(_TEXT.values())} FROM (SELECT *, row_number() OVER (PARTITION BY person_id, cohort_start_date, cohort_end_date ORDER BY abs(event_date - cohort_start_date), event_date, event_key) AS k FROM ({interval}) WHERE event_date BETWEEN cohort_start_date - 365 AND cohort_start_date + 365) WHERE k = 1"),
        "temporal_last_before": (lambda cdm: _days_as_text(temporal.last_before(cond(cdm), cdm.procedure_occurrence.select("procedure_occurrence_id", "person_id", F.col("procedure_date").alias("anchor_date")))), f"SELECT procedure_occurrence_id, person_id, CAST(anchor_date AS VARCHAR) AS anchor_date, CAST(event_date AS VARCHAR) AS event_date, event_key FROM (SELECT p.procedure_occurrence_id, p.person_id, p.procedure_date AS anchor_date, e.event_date, e.event_key, row_number() OVER (PARTITION BY p.procedure_occurrence_id ORDER BY e.event_date DESC, e.event_key) AS k FROM procedure_occurrence p LEFT JOIN {_EV['condition']} e ON e.person_id = p.person_id AND e.event_date <= p.procedure_date) WHERE k = 1"),
    }


def cohort_operators() -> dict[str, Built]:
    """Cohorts, their algebra, criteria and populations."""
    flags = f"SELECT t.*, p.gender_concept_id, year(cohort_start_date) - year_of_birth AS age, (SELECT count(*) FROM {_EV['condition']} e WHERE e.person_id = t.subject_id AND e.concept_id IN (2004, 2005) AND e.event_date - t.cohort_start_date BETWEEN -365 AND 0) AS n FROM {_T[1]} t LEFT JOIN person p ON p.person_id = t.subject_id"
    spec = {"op": "and", "filters": [{"type": "age_range", "min": 30, "max": 80}, {"op": "or", "filters": [{"type": "sex", "value": "F"}, {"type": "has_concept", "domain": "condition", "concepts": [2004, 2005], "window": [-365, 0]}]}]}
    ok = "age BETWEEN 30 AND 80 AND (gender_concept_id = 8532 OR n >= 1)"
    index = "SELECT person_id AS subject_id, event_date AS cohort_start_date, {end} AS cohort_end_date FROM (SELECT *, row_number() OVER (PARTITION BY person_id ORDER BY {order}) AS k FROM (SELECT e.person_id, event_date, event_key, min(observation_period_end_date) AS period_end FROM " + _EV["condition"] + " e JOIN observation_period o ON o.person_id = e.person_id AND event_date BETWEEN observation_period_start_date AND observation_period_end_date WHERE concept_id IN (2001, 2002) GROUP BY ALL HAVING count(*) = 1)) WHERE k = 1"
    leaf = lambda kind, **more: (lambda cdm: cohorts.population(cohorts.stored(cdm, 1), cdm, {"type": kind, **more}))
    return {
        "cohort_from_events": (lambda cdm: _days_as_text(cohorts.from_events(cdm, "condition", [2006, 2007])), _episodes(f"SELECT DISTINCT person_id AS subject_id, event_date AS cohort_start_date, event_end AS cohort_end_date FROM {_EV['condition']} WHERE concept_id IN (2006, 2007)")),
        "cohort_from_value_bin": (lambda cdm: _days_as_text(cohorts.from_events(cdm, "measurement", [3001, 3003], (20.0, 40.0))), _episodes("SELECT DISTINCT person_id AS subject_id, measurement_date AS cohort_start_date, measurement_date AS cohort_end_date FROM measurement WHERE measurement_concept_id IN (3001, 3003) AND value_as_number >= 20 AND value_as_number < 40")),
        "cohort_intersect": (lambda cdm: _days_as_text(cohorts.combine("intersect", [cohorts.stored(cdm, 1), cohorts.stored(cdm, 2)])), _episodes(f"SELECT * FROM {_T[1]} WHERE subject_id IN (SELECT subject_id FROM {_T[2]})")),
        "cohort_union": (lambda cdm: _days_as_text(cohorts.combine("union", [cohorts.stored(cdm, k) for k in (1, 2, 3)])), _episodes(f"SELECT * FROM {_T[1]} UNION SELECT * FROM {_T[2]} UNION SELECT * FROM {_T[3]}")),
        "cohort_setdiff": (lambda cdm: _days_as_text(cohorts.combine("setdiff", [cohorts.stored(cdm, k) for k in (1, 2, 3)])), _episodes(f"SELECT * FROM {_T[1]} WHERE subject_id NOT IN (SELECT subject_id FROM {_T[2]}) AND subject_id NOT IN (SELECT subject_id FROM {_T[3]})")),
        "cohort_numbered": (lambda cdm: _days_as_text(cohorts.numbered(cohorts.stored(cdm, 1))), f"SELECT subject_id, {', '.join(_TEXT.values())}, row_number() OVER (ORDER BY subject_id, t.cohort_start_date, t.cohort_end_date) AS cohort_row_id FROM {_T[1]} t"),
        "cohort_inclusion": (lambda cdm: _days_as_text(cohorts.include(cohorts.stored(cdm, 1), cdm, [cohorts.Criterion("condition", (2004, 2005), 1, "at_least", (-365, 365)), cohorts.Criterion("procedure", (5001,), 0, "exactly")])), _episodes(f"SELECT t.* FROM {_T[1]} t WHERE (SELECT count(*) FROM {_EV['condition']} e WHERE e.person_id = t.subject_id AND concept_id IN (2004, 2005) AND event_date - cohort_start_date BETWEEN -365 AND 365) >= 1 AND (SELECT count(*) FROM {_EV['procedure']} e WHERE e.person_id = t.subject_id AND concept_id = 5001) = 0")),
        "cohort_index_first": (lambda cdm: _days_as_text(cohorts.index_events(cdm, "condition", [2001, 2002])), _episodes(index.format(order="event_date, event_key", end="period_end"))),
        "cohort_index_last": (lambda cdm: _days_as_text(cohorts.index_events(cdm, "condition", [2001, 2002], "last", 60)), _episodes(index.format(order="event_date DESC, event_key DESC", end="least(period_end, event_date + 60)"))),
        "population_any_episode": (lambda cdm: cohorts.population(cohorts.stored(cdm, 1), cdm, spec), f"SELECT DISTINCT subject_id FROM ({flags}) WHERE {ok}"),
        "population_all_episodes": (lambda cdm: cohorts.population(cohorts.stored(cdm, 1), cdm, spec, "all_episodes"), f"SELECT subject_id FROM ({flags}) GROUP BY subject_id HAVING min(CASE WHEN {ok} THEN 1 ELSE 0 END) = 1"),
        "population_first_episode": (lambda cdm: cohorts.population(cohorts.stored(cdm, 1), cdm, spec, "first_episode"), f"SELECT subject_id FROM ({flags.replace(_T[1], _FIRST[1])}) WHERE {ok}"),
        "population_followup": (leaf("followup", days=365), f"SELECT DISTINCT subject_id FROM {_T[1]} t JOIN observation_period o ON o.person_id = t.subject_id AND cohort_start_date BETWEEN observation_period_start_date AND observation_period_end_date WHERE observation_period_end_date - cohort_start_date >= 365"),
        "population_prior_observation": (leaf("prior_observation", days=365), f"SELECT DISTINCT subject_id FROM {_T[1]} t JOIN observation_period o ON o.person_id = t.subject_id AND cohort_start_date BETWEEN observation_period_start_date AND observation_period_end_date WHERE cohort_start_date - observation_period_start_date >= 365"),
        "population_age_group": (leaf("age_group", value=["30-39", "60+"]), f"SELECT DISTINCT subject_id FROM ({flags}) WHERE age BETWEEN 30 AND 39 OR age >= 60"),
        "population_not_has_concept": (leaf("not_has_concept", domain="condition", concepts=[2004]), f"SELECT DISTINCT subject_id FROM {_T[1]} WHERE subject_id NOT IN (SELECT person_id FROM condition_occurrence WHERE condition_concept_id = 2004)"),
        "population_concept_count": (leaf("concept_count", domain="condition", concepts=[2001, 2002], min_count=3), f"SELECT DISTINCT subject_id FROM {_T[1]} WHERE subject_id IN (SELECT person_id FROM condition_occurrence WHERE condition_concept_id IN (2001, 2002) GROUP BY person_id HAVING count(*) >= 3)"),
        "population_visit_count": (leaf("visit_count", min_count=8), f"SELECT DISTINCT subject_id FROM {_T[1]} WHERE subject_id IN (SELECT person_id FROM visit_occurrence GROUP BY person_id HAVING count(*) >= 8)"),
        "population_cohort_member": (leaf("cohort", value=2), f"SELECT DISTINCT subject_id FROM {_T[1]} WHERE subject_id IN (SELECT subject_id FROM {_T[2]})"),
        "population_missing_measurement": (leaf("missing_measurement", concepts=[3001]), f"SELECT DISTINCT subject_id FROM {_T[1]} WHERE subject_id NOT IN (SELECT person_id FROM measurement WHERE measurement_concept_id = 3001 AND value_as_number IS NOT NULL)"),
    }


def feature_operators() -> dict[str, Built]:
    """Reducers, sparse and wide covariates, derived columns, scores."""
    m = (3001, 3003)
    kinds = ("boolean", "count", "n_distinct", "mean_value", "min_value", "max_value", "sum_value", "first_value", "latest_value", "sd_value", "cv_value", "slope_value", "abnormal_high", "abnormal_low", "gap_max_days", "gap_mean_days", "duration_sum")
    specs = [features.Feature(k, k, m) for k in kinds] + [features.Feature("time_since", "time_since", m, reference="2024-02-15"), features.Feature("months_since", "time_since", m, reference="2024-02-15", unit="months")]
    rounded = lambda df: df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])
    v = "(SELECT *, lag(event_date) OVER (PARTITION BY person_id ORDER BY event_date, event_key) AS prev FROM " + _EV["measurement"] + f" WHERE concept_id IN {m})"
    sql = f"""SELECT p.person_id, coalesce(max(CASE WHEN e.person_id IS NULL THEN 0 ELSE 1 END), 0) AS "boolean", count(e.person_id) AS "count", count(DISTINCT concept_id) AS n_distinct,
 round(avg(value), 6) AS mean_value, round(min(value), 6) AS min_value, round(max(value), 6) AS max_value, round(sum(value), 6) AS sum_value,
 round(arg_min(value, (event_date, event_key)) FILTER (value IS NOT NULL), 6) AS first_value, round(arg_max(value, (event_date, -event_key)) FILTER (value IS NOT NULL), 6) AS latest_value,
 round(stddev_samp(value), 6) AS sd_value, round(CASE WHEN count(value) >= 2 AND avg(value) <> 0 THEN 100 * stddev_samp(value) / avg(value) END, 6) AS cv_value,
 round(CASE WHEN count(DISTINCT CASE WHEN value IS NOT NULL THEN event_date END) >= 2 THEN regr_slope(value, event_date - DATE '1970-01-01') END, 6) AS slope_value,
 count(*) FILTER (value > range_high) AS abnormal_high, count(*) FILTER (value < range_low) AS abnormal_low,
 max(event_date - prev) AS gap_max_days, round(avg(event_date - prev), 6) AS gap_mean_days, CAST(sum(event_end - event_date) AS BIGINT) AS duration_sum,
 DATE '2024-02-15' - max(event_date) FILTER (event_date <= DATE '2024-02-15') AS time_since,
 (2024 - year(max(event_date))) * 12 + 2 - month(max(event_date)) - CASE WHEN 15 < day(max(event_date)) THEN 1 ELSE 0 END AS months_since
 FROM person p LEFT JOIN {v} e ON e.person_id = p.person_id GROUP BY p.person_id"""
    auto = f"SELECT person_id, concept_id, count(*) AS n, avg(value) AS mean, min(value) AS min, max(value) AS max FROM {_EV['measurement']} GROUP BY ALL"
    charlson = features.Score({"a": (1.0, (2000, 2001)), "b": (2.0, (2101,)), "c": (6.0, (2010,))}, ages=((65, 1.0), (75, 2.0)), female=1.0)
    present = "(SELECT count(*) > 0 FROM condition_occurrence e JOIN concept_ancestor a ON a.descendant_concept_id = e.condition_concept_id WHERE e.person_id = p.person_id AND a.ancestor_concept_id IN ({}))"
    return {
        "features_person": (lambda cdm: rounded(features.features(_measured(cdm), cdm.person, specs)), sql),
        "features_sparse": (lambda cdm: rounded(features.sparse(_measured(cdm))[0]), f"SELECT person_id, concept_id * 1000 + k AS covariate_id, round(v, 6) AS value FROM (SELECT person_id, concept_id, 1 AS k, 1.0::DOUBLE AS v FROM ({auto}) UNION ALL SELECT person_id, concept_id, 2, n FROM ({auto}) UNION ALL SELECT person_id, concept_id, 3, mean FROM ({auto}) UNION ALL SELECT person_id, concept_id, 4, min FROM ({auto}) UNION ALL SELECT person_id, concept_id, 5, max FROM ({auto})) WHERE v IS NOT NULL"),
        "features_wide": (lambda cdm: rounded(features.wide(_measured(cdm).groupBy("person_id", "concept_id").agg(F.avg("value").alias("value")), cdm.person, {3000: "m0", 3001: "m1", 3003: "m3"})), f"SELECT p.person_id, round(avg(value) FILTER (concept_id = 3000), 6) AS m0, round(avg(value) FILTER (concept_id = 3001), 6) AS m1, round(avg(value) FILTER (concept_id = 3003), 6) AS m3 FROM person p LEFT JOIN {_EV['measurement']} e ON e.person_id = p.person_id GROUP BY p.person_id"),
        "features_dictionary": (lambda cdm: features.dictionary(cdm, _measured(cdm)), f"SELECT DISTINCT e.concept_id, c.concept_name, trim(regexp_replace(lower(c.concept_name), '[^a-z0-9]+', '_', 'g'), '_') AS label FROM {_EV['measurement']} e JOIN concept c ON c.concept_id = e.concept_id"),
        "derived_person": (lambda cdm: features.derived(cdm, "1998-06-01"), """SELECT p.person_id, CASE WHEN 1998 - year_of_birth >= 0 THEN 1998 - year_of_birth END AS age, CASE gender_concept_id WHEN 8507 THEN 'M' WHEN 8532 THEN 'F' END AS sex_mf,
 CASE WHEN coalesce(gender_concept_id, 0) = 0 THEN 1 ELSE 0 END + CASE WHEN coalesce(race_concept_id, 0) = 0 THEN 1 ELSE 0 END + CASE WHEN coalesce(ethnicity_concept_id, 0) = 0 THEN 1 ELSE 0 END AS demo_missingness,
 CAST(obs_total AS BIGINT) AS obs_total, obs_first, obs_last, obs_longest, prior_obs, followup FROM person p
 LEFT JOIN (SELECT person_id, sum(observation_period_end_date - observation_period_start_date) AS obs_total, arg_min(observation_period_end_date - observation_period_start_date, observation_period_start_date) AS obs_first, arg_max(observation_period_end_date - observation_period_start_date, observation_period_start_date) AS obs_last, max(observation_period_end_date - observation_period_start_date) AS obs_longest FROM observation_period GROUP BY person_id) o ON o.person_id = p.person_id
 LEFT JOIN (SELECT person_id, max(DATE '1998-06-01' - observation_period_start_date) AS prior_obs, max(observation_period_end_date - DATE '1998-06-01') AS followup FROM observation_period WHERE DATE '1998-06-01' BETWEEN observation_period_start_date AND observation_period_end_date GROUP BY person_id) a ON a.person_id = p.person_id"""),
        "score_weighted": (lambda cdm: features.score(cdm, charlson, 1998), f"SELECT person_id, CASE WHEN {present.format('2000, 2001')} THEN 1.0 ELSE 0.0 END + CASE WHEN {present.format('2101')} THEN 2.0 ELSE 0.0 END + CASE WHEN {present.format('2010')} THEN 6.0 ELSE 0.0 END + CASE WHEN 1998 - year_of_birth >= 75 THEN 2.0 WHEN 1998 - year_of_birth >= 65 THEN 1.0 ELSE 0.0 END + CASE WHEN gender_concept_id = 8532 THEN 1.0 ELSE 0.0 END AS score FROM person p"),
        "code_patterns": (lambda cdm: features.code_patterns(cdm, ["source condition 1%"]), "SELECT DISTINCT concept_id_2 AS concept_id FROM concept_relationship JOIN concept ON concept_id = concept_id_1 WHERE lower(concept_name) LIKE 'source condition 1%' AND relationship_id = 'Maps to' AND invalid_reason IS NULL"),
    }


def survival_operators() -> dict[str, Built]:
    """Risk sets and the five formats."""
    risk = survival.Risk(start=1, end=365, washout=30)
    outcomes = (1, 2)

    def sets(cdm: Cdm) -> DataFrame:
        return survival.risk_sets(cohorts.stored(cdm, 2), cdm.observation_period, cdm.death, risk)

    def ev(cdm: Cdm) -> DataFrame:
        e = cohorts.events(cdm, "condition", [2003, 2004, 2005, 2006])
        return e.select("person_id", F.when(F.col("concept_id") <= 2004, 1).otherwise(2).cast("long").alias("outcome"), "event_date")

    seen = f"(SELECT t.subject_id, t.cohort_start_date, t.cohort_end_date, min(observation_period_start_date) AS obs_start, max(observation_period_end_date) AS obs_end FROM {_T[2]} t JOIN observation_period o ON o.person_id = t.subject_id AND t.cohort_start_date BETWEEN observation_period_start_date AND observation_period_end_date GROUP BY ALL HAVING count(*) = 1)"
    base = f"""WITH sets AS (SELECT * FROM (SELECT s.subject_id, s.cohort_start_date, s.cohort_end_date, s.cohort_start_date + 1 AS entry, least(s.cohort_end_date, s.obs_end, d.death_date, s.cohort_start_date + 365) AS exit_day FROM {seen} s LEFT JOIN death d ON d.person_id = s.subject_id WHERE s.cohort_start_date - s.obs_start >= 30 AND (d.death_date IS NULL OR d.death_date >= s.cohort_start_date)) WHERE exit_day >= entry),
 days AS (SELECT DISTINCT person_id, CASE WHEN concept_id <= 2004 THEN 1 ELSE 2 END AS outcome, event_date FROM {_EV['condition']} WHERE concept_id BETWEEN 2003 AND 2006),
 kept AS (SELECT * FROM (SELECT *, event_date - lag(event_date) OVER (PARTITION BY person_id, outcome ORDER BY event_date) AS gap FROM days) WHERE gap IS NULL OR gap > 30),
 hits AS (SELECT s.*, outcome, event_date FROM sets s JOIN kept k ON k.person_id = s.subject_id AND event_date BETWEEN entry AND exit_day) """
    keys = ", ".join(_TEXT.values())

    episode = "subject_id, cohort_start_date, cohort_end_date"
    states_sql = f"""WITH RECURSIVE {base.removeprefix('WITH ')},
 graph(a, b) AS (VALUES (1, 2), (2, 3), (3, 2)),
 moves AS (SELECT *, row_number() OVER (PARTITION BY {episode} ORDER BY moment, st) AS k FROM (SELECT {episode}, st, event_date - entry + (row_number() OVER (PARTITION BY {episode}, event_date ORDER BY st) - 1) / count(*) OVER (PARTITION BY {episode}, event_date) AS moment FROM sets s JOIN (SELECT DISTINCT person_id, outcome + 1 AS st, event_date FROM days) e ON e.person_id = s.subject_id AND event_date BETWEEN entry AND exit_day)),
 walk AS (SELECT {episode}, CAST(0 AS BIGINT) AS k, 1 AS state, CAST(0 AS DOUBLE) AS since, CAST(NULL AS INT) AS was, CAST(NULL AS DOUBLE) AS was_since FROM sets
  UNION ALL SELECT w.subject_id, w.cohort_start_date, w.cohort_end_date, m.k, CASE WHEN g.a IS NULL THEN w.state ELSE m.st END, CASE WHEN g.a IS NULL THEN w.since ELSE m.moment END, g.a, CASE WHEN g.a IS NOT NULL THEN w.since END
   FROM walk w JOIN moves m ON m.subject_id = w.subject_id AND m.cohort_start_date = w.cohort_start_date AND m.cohort_end_date = w.cohort_end_date AND m.k = w.k + 1 LEFT JOIN graph g ON g.a = w.state AND g.b = m.st),
 ends AS (SELECT {episode}, arg_max(state, k) AS state, arg_max(since, k) AS since FROM walk GROUP BY ALL),
 out AS (SELECT {episode}, was AS f, b AS t, was_since AS start, since AS stop, CASE WHEN b = state THEN 1 ELSE 0 END AS status FROM walk JOIN graph ON a = was
  UNION ALL SELECT {episode}, state, b, since, exit_day - entry, 0 FROM ends JOIN sets USING (subject_id, cohort_start_date, cohort_end_date) JOIN graph ON a = state WHERE exit_day - entry > since)
SELECT subject_id, {keys}, CAST(f AS BIGINT) AS from_state, CAST(t AS BIGINT) AS to_state, start, CAST(stop AS DOUBLE) AS stop, CAST(status AS BIGINT) AS status FROM out"""

    def states(cdm: Cdm) -> DataFrame:
        names, edges = survival.transition_graph([("well", "ill"), ("ill", "worse"), ("worse", "ill")])
        e = cohorts.events(cdm, "condition", [2003, 2004, 2005, 2006])
        return _days_as_text(survival.multi_state(sets(cdm), e.select("person_id", F.when(F.col("concept_id") <= 2004, "ill").otherwise("worse").alias("state"), "event_date"), names, edges, "well"))

    return {
        "survival_first": (lambda cdm: _days_as_text(survival.survival(sets(cdm), ev(cdm), outcomes, risk)), base + f"SELECT s.subject_id, {keys.replace('CAST(c', 'CAST(s.c')}, o.outcome, CASE WHEN h.event_date IS NULL THEN 0 ELSE 1 END AS status, coalesce(h.event_date, s.exit_day) - s.entry AS time FROM sets s CROSS JOIN (SELECT unnest([1, 2]) AS outcome) o LEFT JOIN (SELECT subject_id, cohort_start_date AS cs, cohort_end_date AS ce, outcome, min(event_date) AS event_date FROM hits GROUP BY ALL) h ON h.subject_id = s.subject_id AND h.cs = s.cohort_start_date AND h.ce = s.cohort_end_date AND h.outcome = o.outcome"),
        "survival_competing_risk": (lambda cdm: _days_as_text(survival.competing_risk(sets(cdm), ev(cdm), outcomes, risk)), base + f"SELECT s.subject_id, {keys.replace('CAST(c', 'CAST(s.c')}, coalesce(h.outcome, 0) AS status, coalesce(h.event_date, s.exit_day) - s.entry AS time FROM sets s LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY subject_id, cohort_start_date, cohort_end_date ORDER BY event_date, outcome) AS k FROM hits) h ON h.subject_id = s.subject_id AND h.cohort_start_date = s.cohort_start_date AND h.cohort_end_date = s.cohort_end_date AND h.k = 1"),
        "survival_recurrent": (lambda cdm: _days_as_text(survival.recurrent(sets(cdm), ev(cdm), risk)), base + f"SELECT h.subject_id, {keys.replace('CAST(c', 'CAST(h.c')}, outcome, event_date - entry AS time, row_number() OVER (PARTITION BY h.subject_id, h.cohort_start_date, h.cohort_end_date ORDER BY event_date, outcome) AS event_number, row_number() OVER (PARTITION BY h.subject_id, h.cohort_start_date, h.cohort_end_date, outcome ORDER BY event_date) AS outcome_event_number FROM hits h"),
        "survival_counting_process": (lambda cdm: _days_as_text(survival.counting_process(sets(cdm), ev(cdm), risk)), base + f", stops AS (SELECT DISTINCT subject_id, cohort_start_date, cohort_end_date, event_date - entry AS stop FROM hits), steps AS (SELECT *, coalesce(lag(stop) OVER (PARTITION BY subject_id, cohort_start_date, cohort_end_date ORDER BY stop), -1) AS start FROM stops) SELECT s.subject_id, {keys.replace('CAST(c', 'CAST(s.c')}, start, stop, 1 AS event FROM steps s UNION ALL SELECT * FROM (SELECT s.subject_id, {keys.replace('CAST(c', 'CAST(s.c')}, coalesce((SELECT max(stop) FROM stops x WHERE x.subject_id = s.subject_id AND x.cohort_start_date = s.cohort_start_date AND x.cohort_end_date = s.cohort_end_date), -1) AS start, s.exit_day - s.entry AS stop, 0 AS event FROM sets s) WHERE stop > start"),
        "survival_multi_state": (states, states_sql),
    }


def profile_operators() -> dict[str, Built]:
    """Profiles, vocabulary and gated results."""
    policy = gate.Policy()
    nums = lambda cdm: cdm.measurement
    means = "(SELECT person_id, avg(value_as_number) AS v FROM measurement WHERE value_as_number IS NOT NULL GROUP BY person_id)"
    gated = "SELECT concept_id, CAST(floor(p / 5) * 5 AS BIGINT) AS n_persons, CAST(floor(r / 5) * 5 AS BIGINT) AS n_records FROM (SELECT {c} AS concept_id, count(DISTINCT person_id) AS p, count(*) AS r FROM {t} GROUP BY ALL) WHERE p >= 3 AND r >= 3"
    three = lambda cdm: concepts.ids(cdm, [2001, 2005, 2010])
    below = "SELECT descendant_concept_id FROM concept_ancestor WHERE ancestor_concept_id IN"
    return {
        "profile_table_stats": (lambda cdm: profile.table_stats(cdm.condition_occurrence), "SELECT count(*) AS n_records, count(DISTINCT person_id) AS n_persons FROM condition_occurrence"),
        "profile_column_stats": (lambda cdm: profile.column_stats(nums(cdm), ["value_as_number", "unit_concept_id"]), " UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) AS n_total, count(*) - count({c}) AS n_missing, count(DISTINCT {c}) AS n_distinct, count(DISTINCT CASE WHEN {c} IS NOT NULL THEN person_id END) AS n_persons FROM measurement" for c in ("value_as_number", "unit_concept_id"))),
        "profile_person_numeric": (lambda cdm: profile.person_numeric(nums(cdm), "value_as_number"), f"SELECT count(v) AS n_persons, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS sd FROM {means}"),
        "profile_missingness": (lambda cdm: profile.missingness(cdm.condition_occurrence, ["condition_end_date", "provider_id"]), " UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) AS n_persons, count(*) FILTER (k = 0) AS n_missing, round(count(*) FILTER (k = 0) / count(*), 2) AS missing_rate FROM (SELECT person_id, count({c}) AS k FROM condition_occurrence GROUP BY person_id)" for c in ("condition_end_date", "provider_id"))),
        "profile_value_counts": (lambda cdm: profile.value_counts(cdm.drug_exposure, "route_concept_id"), "SELECT route_concept_id AS value, count(*) AS n_records, count(DISTINCT person_id) AS n_persons FROM drug_exposure GROUP BY ALL"),
        "profile_prevalence_gated": (lambda cdm: profile.prevalence(cdm.condition_occurrence, "condition_concept_id", policy), gated.format(c="condition_concept_id", t="condition_occurrence")),
        "profile_prevalence_page": (lambda cdm: profile.prevalence(cdm.drug_exposure, "drug_concept_id", policy, offset=10, limit=20), gated.format(c="drug_concept_id", t="drug_exposure") + " ORDER BY n_persons DESC, concept_id NULLS LAST LIMIT 20 OFFSET 10"),
        "profile_domain_coverage": (lambda cdm: profile.domain_coverage(cdm, ["condition_occurrence", "measurement", "death"]), " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(DISTINCT person_id) AS n_persons FROM {t}" for t in ("condition_occurrence", "measurement", "death"))),
        "profile_quarters": (lambda cdm: profile.date_counts(cdm.condition_occurrence, "condition_start_date", "quarter"), "SELECT concat(year(condition_start_date), '-Q', quarter(condition_start_date)) AS period, count(*) AS n_records, count(DISTINCT person_id) AS n_persons FROM condition_occurrence GROUP BY ALL"),
        "profile_months": (lambda cdm: profile.date_counts(cdm.condition_occurrence, "condition_start_date", "month"), "SELECT strftime(condition_start_date, '%Y-%m') AS period, count(*) AS n_records, count(DISTINCT person_id) AS n_persons FROM condition_occurrence GROUP BY ALL"),
        "profile_offset_quantiles": (lambda cdm: profile.offset_quantiles(nums(cdm), "value_as_number", (0.05, 0.5, 0.95), 3), f"SELECT round(max(v) FILTER (k = least(greatest(CAST(floor((n - 1) * 0.05) AS BIGINT), 3), n - 4)), 6) AS p05, round(max(v) FILTER (k = least(greatest(CAST(floor((n - 1) * 0.5) AS BIGINT), 3), n - 4)), 6) AS p50, round(max(v) FILTER (k = least(greatest(CAST(floor((n - 1) * 0.95) AS BIGINT), 3), n - 4)), 6) AS p95 FROM (SELECT v, row_number() OVER (ORDER BY v) - 1 AS k, count(*) OVER () AS n FROM {means})"),
        "profile_histogram": (lambda cdm: profile.histogram(nums(cdm), "value_as_number", profile.equal_breaks(0, 100, 5)), "SELECT CAST(least(floor(value_as_number / 20), 4) AS BIGINT) AS bin, count(*) AS n_records, count(DISTINCT person_id) AS n_persons FROM measurement WHERE value_as_number BETWEEN 0 AND 100 GROUP BY ALL"),
        "profile_locate": (lambda cdm: profile.locate(cdm, [2001, 2002], [("condition_occurrence", "condition_concept_id"), ("death", "cause_concept_id")]), " UNION ALL ".join(f"SELECT '{t}' AS table_name, '{c}' AS column_name, {c} AS concept_id, count(*) AS n_records, count(DISTINCT person_id) AS n_persons FROM {t} WHERE {c} IN (2001, 2002) GROUP BY ALL" for t, c in (("condition_occurrence", "condition_concept_id"), ("death", "cause_concept_id")))),
        "profile_crosstab": (lambda cdm: profile.crosstab(cdm.person, "gender_concept_id", "ethnicity_concept_id").withColumnsRenamed({"row": "gender", "col": "ethnicity"}), "SELECT r.gender, c.ethnicity, count(DISTINCT person_id) AS n_persons FROM (SELECT DISTINCT gender_concept_id AS gender FROM person WHERE ethnicity_concept_id IS NOT NULL) r CROSS JOIN (SELECT DISTINCT ethnicity_concept_id AS ethnicity FROM person WHERE ethnicity_concept_id IS NOT NULL) c LEFT JOIN person p ON p.gender_concept_id = r.gender AND p.ethnicity_concept_id = c.ethnicity GROUP BY ALL"),
        "gate_distribution": (lambda cdm: gate.gate(standard.catalog()[706].build(cdm), "dist", ["count_value"], policy, summary=["avg_value", "stdev_value", *standard.QUANTILES]), f"SELECT stratum_1, CAST(floor(count_value / 5) * 5 AS BIGINT) AS count_value, {', '.join(f'CASE WHEN count_value >= 10 THEN {c} END AS {c}' for c in ('avg_value', 'stdev_value', *standard.QUANTILES))} FROM ({standard.catalog()[706].sql}) WHERE count_value >= 3"),
        "vocabulary_search": (lambda cdm: concepts.search(cdm, "condition 1", standard=True).select("concept_id", "concept_name"), "SELECT concept_id, concept_name FROM concept WHERE contains(lower(concept_name), 'condition') AND contains(lower(concept_name), '1') AND standard_concept = 'S'"),
        "vocabulary_hierarchy": (lambda cdm: concepts.hierarchy(cdm, concepts.ids(cdm, [2101, 2003])), "SELECT DISTINCT 'ancestor' AS direction, ancestor_concept_id AS concept_id, min_levels FROM concept_ancestor WHERE descendant_concept_id IN (2101, 2003) AND min_levels >= 1 UNION SELECT 'descendant', descendant_concept_id, min_levels FROM concept_ancestor WHERE ancestor_concept_id IN (2101, 2003) AND min_levels >= 1"),
        "vocabulary_expand": (lambda cdm: concepts.expand(cdm, concepts.ConceptSet((2101, 2002), True, True, (2005,))), f"WITH s AS (SELECT unnest([2101, 2002]) AS concept_id UNION {below} (2101, 2002)), m AS (SELECT concept_id FROM s UNION SELECT concept_id_1 FROM concept_relationship WHERE relationship_id = 'Maps to' AND invalid_reason IS NULL AND concept_id_2 IN (SELECT concept_id FROM s)) SELECT concept_id FROM m WHERE concept_id NOT IN (SELECT 2005 UNION {below} (2005))"),
        "vocabulary_relationships": (lambda cdm: concepts.relationships(cdm, three(cdm)), "SELECT 'forward' AS direction, concept_id_1 AS concept_id, concept_id_2 AS related_id, relationship_id FROM concept_relationship WHERE concept_id_1 IN (2001, 2005, 2010) UNION ALL SELECT 'reverse', concept_id_2, concept_id_1, relationship_id FROM concept_relationship WHERE concept_id_2 IN (2001, 2005, 2010)"),
        "vocabulary_synonyms": (lambda cdm: concepts.synonyms(cdm, three(cdm)), "SELECT concept_id, concept_synonym_name FROM concept_synonym WHERE concept_id IN (2001, 2005, 2010)"),
        "vocabulary_facets": (lambda cdm: concepts.facets(cdm), "SELECT vocabulary_id AS value, count(*) AS n, 'vocabulary' AS facet FROM concept GROUP BY ALL UNION ALL SELECT domain_id, count(*), 'domain' FROM concept GROUP BY ALL"),
        "vocabulary_translate": (lambda cdm: concepts.translate(cdm.death.select("person_id", "cause_concept_id"), cdm, ["cause_concept_id"]), "SELECT person_id, cause_concept_id, concept_name AS cause_name FROM death LEFT JOIN concept ON concept_id = cause_concept_id"),
        "noise_bounded_records": (lambda cdm: noise.bounded_records(cdm.condition_occurrence, 5), "SELECT CAST(sum(least(k, 5)) AS BIGINT) AS value FROM (SELECT count(*) AS k FROM condition_occurrence GROUP BY person_id)"),
        "noise_categorical": (lambda cdm: noise.categorical_histogram(cdm.condition_occurrence, "condition_concept_id", [2001, 2002, 2099], 2, ["condition_start_date", "condition_occurrence_id"]), "SELECT l.level, count(c.k) AS value FROM (SELECT unnest([2001, 2002, 2099]) AS level) l LEFT JOIN (SELECT * FROM (SELECT condition_concept_id, row_number() OVER (PARTITION BY person_id ORDER BY condition_start_date, condition_occurrence_id) AS k FROM condition_occurrence WHERE condition_concept_id IN (2001, 2002, 2099)) WHERE k <= 2) c ON c.condition_concept_id = l.level GROUP BY ALL"),
        "noise_distinct": (lambda cdm: noise.bounded_distinct(cdm.condition_occurrence, "condition_concept_id", 2), "SELECT count(DISTINCT condition_concept_id) AS value FROM (SELECT *, row_number() OVER (PARTITION BY person_id ORDER BY condition_concept_id) AS k FROM (SELECT DISTINCT person_id, condition_concept_id FROM condition_occurrence)) WHERE k <= 2"),
        "noise_mean_parts": (lambda cdm: noise.bounded_mean(cdm.measurement, "value_as_number", 0.0, 100.0, "max"), "SELECT count(*) AS n, CAST(sum(round(least(greatest(v, 0.0), 100.0) / 100.0 * 65535)) AS BIGINT) AS total FROM (SELECT max(value_as_number) AS v FROM measurement WHERE value_as_number IS NOT NULL GROUP BY person_id)"),
    }


def analysis_operators() -> dict[str, Built]:
    """Population analyses."""
    t = {k: (lambda cdm, k=k: cohorts.stored(cdm, k)) for k in (1, 2, 3)}
    cond = lambda cdm: cohorts.events(cdm, "condition")
    proc = lambda cdm: cohorts.events(cdm, "procedure")
    risk = f"(SELECT t.*, t.cohort_start_date AS risk_start, least(cohort_end_date, cohort_start_date + 365) AS risk_end FROM {_FIRST[2]} t)"
    substrate = f"(SELECT r.subject_id, r.cohort_start_date, risk_end - risk_start + 1 AS days, count(DISTINCT o.cohort_start_date) AS n_events, min(o.cohort_start_date) - risk_start AS days_to_event FROM {risk} r LEFT JOIN {_T[1]} o ON o.subject_id = r.subject_id AND o.cohort_start_date BETWEEN risk_start AND risk_end WHERE risk_end >= risk_start GROUP BY r.subject_id, r.cohort_start_date, risk_start, risk_end)"
    rates = "count(*) AS n_persons, CAST(sum(days) AS BIGINT) AS person_days, CAST(sum(n_events) AS BIGINT) AS n_outcomes, count(*) FILTER (n_events > 0) AS n_with_outcome, round(count(*) FILTER (n_events > 0) / count(*), 6) AS proportion, round(sum(n_events) / (sum(days) / 365.25) * 1000, 6) AS rate"
    share = lambda k: f"SELECT concept_id, count(DISTINCT subject_id) AS n_subjects, round(count(DISTINCT subject_id) / (SELECT count(DISTINCT subject_id) FROM {_T[k]}), 6) AS share FROM {_EV['condition']} e JOIN {_T[k]} t ON t.subject_id = e.person_id WHERE event_date - cohort_start_date BETWEEN -365 AND -1 AND concept_id <> 0 GROUP BY concept_id"
    in_period = "JOIN observation_period o ON o.person_id = t.subject_id AND t.cohort_start_date BETWEEN observation_period_start_date AND observation_period_end_date"
    layered = f"(SELECT *, row_number() OVER (PARTITION BY subject_id ORDER BY event_date, concept_id) AS layer FROM (SELECT *, lag(concept_id) OVER (PARTITION BY subject_id ORDER BY event_date, concept_id) AS last FROM (SELECT DISTINCT t.subject_id, concept_id, event_date FROM {_EV['procedure']} e JOIN {_FIRST[1]} t ON t.subject_id = e.person_id WHERE event_date >= cohort_start_date)) WHERE last IS NULL OR last <> concept_id)"
    demo = f"(SELECT t.subject_id, p.*, CAST(floor((year(t.cohort_start_date) - year_of_birth) / 10) * 10 AS BIGINT) AS age FROM {_FIRST[1]} t JOIN person p ON p.person_id = t.subject_id)"
    return {
        "incidence_rate": (lambda cdm: analyses.incidence_rate(t[2](cdm), t[1](cdm), cdm, 0, 365), f"SELECT {rates} FROM {substrate}"),
        "incidence_rate_strata": (lambda cdm: analyses.incidence_rate(t[2](cdm), t[1](cdm), cdm, 0, 365, ("gender", "age_band", "year")), f"SELECT gender_concept_id AS gender, CAST(floor((year(cohort_start_date) - year_of_birth) / 10) * 10 AS BIGINT) AS age_band, year(cohort_start_date) AS year, {rates} FROM {substrate} s JOIN person p ON p.person_id = s.subject_id GROUP BY 1, 2, 3"),
        "index_event_breakdown": (lambda cdm: analyses.index_breakdown(t[2](cdm), cdm, "condition"), f"SELECT concept_id, count(*) AS n_events, count(DISTINCT subject_id) AS n_subjects FROM {_T[2]} t JOIN {_EV['condition']} e ON e.person_id = t.subject_id AND e.event_date = t.cohort_start_date GROUP BY ALL"),
        "time_distribution": (lambda cdm: analyses.time_distribution(t[1](cdm), cdm), standard.distribution_sql(f"SELECT measure, subject_id, avg(days) AS v FROM (SELECT subject_id, 'prior_observation' AS measure, cohort_start_date - observation_period_start_date AS days FROM {_T[1]} t {in_period} UNION ALL SELECT subject_id, 'follow_up', observation_period_end_date - cohort_start_date FROM {_T[1]} t {in_period} UNION ALL SELECT subject_id, 'time_in_cohort', cohort_end_date - cohort_start_date FROM {_T[1]} t {in_period}) GROUP BY ALL", "v", "measure")),
        "followup_distribution": (lambda cdm: standard.distribution(analyses.outcome_substrate(t[2](cdm), t[1](cdm), 0, 365), "days"), standard.distribution_sql(substrate, "days")),
        "time_to_event": (lambda cdm: analyses.time_to_event(t[2](cdm), cond(cdm), 30, -360, 359, 3), f"SELECT bin, CAST(sum(least(k, 3)) AS BIGINT) AS n_events, count(*) AS n_subjects FROM (SELECT subject_id, CAST(floor((event_date - cohort_start_date) / 30) * 30 AS BIGINT) AS bin, count(*) AS k FROM {_T[2]} t JOIN {_EV['condition']} e ON e.person_id = t.subject_id WHERE event_date - cohort_start_date BETWEEN -360 AND 359 GROUP BY ALL) GROUP BY bin"),
        "visit_context": (lambda cdm: analyses.visit_context(t[2](cdm), cdm), f"SELECT visit_concept_id, CASE WHEN visit_end_date < cohort_start_date THEN 'before' WHEN visit_start_date > cohort_start_date THEN 'after' WHEN visit_start_date = cohort_start_date THEN 'on' ELSE 'during' END AS position, count(DISTINCT subject_id) AS n_subjects FROM {_T[2]} t JOIN visit_occurrence v ON v.person_id = t.subject_id GROUP BY ALL"),
        "covariate_prevalence": (lambda cdm: analyses.covariate_prevalence(t[1](cdm), cond(cdm), -365, -1), share(1)),
        "covariate_values": (lambda cdm: analyses.covariate_values(cohorts.everyone(cdm), cdm, -20000, 20000), standard.distribution_sql("SELECT measurement_concept_id AS concept_id, m.person_id, avg(value_as_number) AS v FROM measurement m JOIN observation_period o ON o.person_id = m.person_id WHERE value_as_number IS NOT NULL AND measurement_date - observation_period_start_date BETWEEN -20000 AND 20000 GROUP BY ALL", "v", "concept_id")),
        "demographics": (lambda cdm: analyses.demographics(t[1](cdm), cdm), " UNION ALL ".join(f"SELECT '{k}' AS kind, {c} AS level, count(DISTINCT subject_id) AS n_subjects FROM {demo} GROUP BY ALL" for k, c in (("gender", "gender_concept_id"), ("race", "race_concept_id"), ("ethnicity", "ethnicity_concept_id"), ("age", "age")))),
        "covariate_balance": (lambda cdm: analyses.standardised_difference(analyses.covariate_prevalence(t[1](cdm), cond(cdm), -365, -1), analyses.covariate_prevalence(t[2](cdm), cond(cdm), -365, -1)), f"SELECT concept_id, p1, p2, CASE WHEN (p1 * (1 - p1) + p2 * (1 - p2)) / 2 > 0 THEN round((p1 - p2) / sqrt((p1 * (1 - p1) + p2 * (1 - p2)) / 2), 5) END AS smd FROM (SELECT coalesce(a.concept_id, b.concept_id) AS concept_id, coalesce(a.share, 0) AS p1, coalesce(b.share, 0) AS p2 FROM ({share(1)}) a FULL JOIN ({share(2)}) b ON a.concept_id = b.concept_id)"),
        "cohort_overlap": (lambda cdm: analyses.overlap(t[1](cdm), t[2](cdm)), f'SELECT count(*) FILTER (a IS NOT NULL AND b IS NOT NULL) AS "both", count(*) FILTER (b IS NULL) AS a_only, count(*) FILTER (a IS NULL) AS b_only, count(*) AS either FROM (SELECT x.subject_id AS a, y.subject_id AS b FROM (SELECT DISTINCT subject_id FROM {_T[1]}) x FULL JOIN (SELECT DISTINCT subject_id FROM {_T[2]}) y ON x.subject_id = y.subject_id)'),
        "cohort_count": (lambda cdm: analyses.cohort_count(t[1](cdm)), f"SELECT count(*) AS entries, count(DISTINCT subject_id) AS subjects FROM {_T[1]}"),
        "cohort_time_series": (lambda cdm: analyses.time_series(t[1](cdm)), f"SELECT year(cohort_start_date) AS year, count(DISTINCT subject_id) AS subjects, count(*) AS records, CAST(sum(cohort_end_date - cohort_start_date + 1) AS BIGINT) AS person_days FROM {_T[1]} GROUP BY 1"),
        "two_arm_era": (lambda cdm: _days_as_text(analyses.two_arms(t[1](cdm), t[2](cdm))[0]), _episodes(f"SELECT a.subject_id, a.cohort_start_date, least(a.cohort_end_date, b.cohort_start_date - 1) AS cohort_end_date FROM {_FIRST[1]} a LEFT JOIN {_FIRST[2]} b ON b.subject_id = a.subject_id WHERE b.cohort_start_date IS NULL OR b.cohort_start_date > a.cohort_start_date")),
        "attrition": (lambda cdm: analyses.attrition(t[1](cdm), cdm, [2004], [2007], (30, 80), 100), f"""WITH j AS (SELECT t.*, t.subject_id IN (SELECT person_id FROM condition_occurrence WHERE condition_concept_id = 2004) AS r, t.subject_id NOT IN (SELECT person_id FROM condition_occurrence WHERE condition_concept_id = 2007) AS x, year(cohort_start_date) - year_of_birth BETWEEN 30 AND 80 AS a, coalesce(cohort_start_date - (SELECT min(observation_period_start_date) FROM observation_period o WHERE o.person_id = t.subject_id) >= 100, false) AS pr FROM {_T[1]} t JOIN person p ON p.person_id = t.subject_id)
SELECT 0 AS step, 'start' AS rule, count(DISTINCT subject_id) AS persons, count(*) AS exposures FROM j UNION ALL SELECT 1, 'require', count(DISTINCT subject_id), count(*) FROM j WHERE r UNION ALL SELECT 2, 'exclude', count(DISTINCT subject_id), count(*) FROM j WHERE r AND x UNION ALL SELECT 3, 'age', count(DISTINCT subject_id), count(*) FROM j WHERE r AND x AND a UNION ALL SELECT 4, 'prior', count(DISTINCT subject_id), count(*) FROM j WHERE r AND x AND a AND pr"""),
        "outcome_rate_by_month": (lambda cdm: analyses.outcome_rate_by_month(t[1](cdm), cdm), f"SELECT year(e) * 100 + month(e) AS month, count(*) AS n_events, count(DISTINCT subject_id) AS n_subjects FROM (SELECT DISTINCT t.subject_id, t.cohort_start_date AS e FROM {_T[1]} t {in_period}) GROUP BY 1"),
        "case_series": (lambda cdm: analyses.case_series(t[2](cdm), t[1](cdm), cdm), f"""WITH f AS (SELECT t.subject_id, t.cohort_start_date AS s, least(t.cohort_end_date, observation_period_end_date) AS e FROM {_FIRST[2]} t {in_period}),
 o AS (SELECT DISTINCT t.subject_id, t.cohort_start_date AS d FROM {_T[1]} t {in_period})
SELECT f.subject_id, count(*) AS events, count(*) FILTER (d BETWEEN s AND e) AS exposed_events, (SELECT CAST(sum(observation_period_end_date - observation_period_start_date + 1) AS BIGINT) FROM observation_period p WHERE p.person_id = f.subject_id) AS days, e - s + 1 AS exposed_days FROM f JOIN o ON o.subject_id = f.subject_id GROUP BY f.subject_id, s, e"""),
        "pathways": (lambda cdm: analyses.pathways(t[1](cdm), proc(cdm)), f"SELECT path, count(*) AS n_subjects FROM (SELECT subject_id, string_agg(concept_id, '>' ORDER BY layer) AS path FROM {layered} WHERE layer <= 5 GROUP BY subject_id) GROUP BY path"),
        "percentage_treated": (lambda cdm: analyses.percentage_treated(t[1](cdm), proc(cdm)), f"SELECT layer, concept_id, count(DISTINCT subject_id) AS n_subjects, round(count(DISTINCT subject_id) / (SELECT count(DISTINCT subject_id) FROM {_T[1]}), 6) AS share FROM {layered} WHERE layer <= 5 GROUP BY ALL"),
        "orphan_concepts": (lambda cdm: analyses.orphan_concepts(cdm, concepts.ids(cdm, [2001, 2002]), "condition"), f"SELECT concept_id, count(*) AS n_records, count(DISTINCT person_id) AS n_subjects FROM {_EV['condition']} WHERE concept_id NOT IN (2001, 2002) AND concept_id IN (SELECT descendant_concept_id FROM concept_ancestor WHERE ancestor_concept_id IN (SELECT ancestor_concept_id FROM concept_ancestor WHERE descendant_concept_id IN (2001, 2002))) GROUP BY ALL"),
    }


def catalog() -> dict[str, Built]:
    """All of them by name."""
    return {**row_operators(), **cohort_operators(), **feature_operators(), **survival_operators(), **profile_operators(), **analysis_operators()}
