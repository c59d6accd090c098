"""A session over a small database made here: schema rules, plans, releases, staging, precomputed results and scores."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidewell.operators import features, filters, gate, noise, profile, survival, tokens, verbs
from tidewell.operators.cohorts import Criterion
from tidewell.operators.concepts import ConceptSet
from tidewell.operators.gate import DisclosureError, Policy
from tidewell.plans import outputs, scores
from tidewell.plans.extract import SpecError, check_bins, classify, columns_of, extract, generic_dates
from tidewell.plans.outputs import Plan
from tidewell.plans.registry import Entry
from tidewell.session import Session
from tidewell.sources import results, sinks
from tidewell.sources.blueprint import Blueprint
from tidewell.sources.cdm import Cdm

D = dt.date


@pytest.fixture(scope="module")
def tables(spark):
    """15 persons; diabetes, lung disease and asthma; one drug; measurements with and without a range; visits; deaths."""
    make = spark.createDataFrame
    ids = range(1, 16)
    conditions = [(p, 201820) for p in (1, 3, 5, 7, 9, 11)] + [(p, 255573) for p in (5, 7, 9, 13)] + [(p, 317009) for p in (2, 4)]
    start = lambda k: D(2021, 1, 1) + dt.timedelta(days=30 * k)
    return {
        "person": make([(p, 8507 if p % 2 else 8532, 1960 + 2 * p, None if p % 2 else 38003564, f"src{p}") for p in ids], "person_id long, gender_concept_id int, year_of_birth int, ethnicity_concept_id int, person_source_value string").withColumn("race_concept_id", F.lit(8527)),
        "observation_period": make([(p, p, D(2020, 1, 1), D(2024, 12, 31)) for p in ids], "observation_period_id long, person_id long, observation_period_start_date date, observation_period_end_date date"),
        "condition_occurrence": make([(k, p, c, start(k), start(k) + dt.timedelta(days=9) if k % 2 else None, 32817, k) for k, (p, c) in enumerate(conditions, 1)], "condition_occurrence_id long, person_id long, condition_concept_id int, condition_start_date date, condition_end_date date, condition_type_concept_id int, visit_occurrence_id long"),
        "drug_exposure": make([(k, p, 1124300, start(k), start(k + 1), 32817, 10.0) for k, p in enumerate((1, 3, 5, 7), 1)], "drug_exposure_id long, person_id long, drug_concept_id int, drug_exposure_start_date date, drug_exposure_end_date date, drug_type_concept_id int, quantity double"),
        "measurement": make([(k, k, 3004410, D(2021, 6, k), float(k), 4.0, 6.0) for k in range(1, 14)], "measurement_id long, person_id long, measurement_concept_id int, measurement_date date, value_as_number double, range_low double, range_high double"),
        "procedure_occurrence": make([(k, k, 4001, D(2021, 3, k), k) for k in range(1, 6)], "procedure_occurrence_id long, person_id long, procedure_concept_id int, procedure_date date, visit_occurrence_id long"),
        "visit_occurrence": make([(k, k, 9201, D(2021, 3, k), D(2021, 3, k + 2), 1, 2) for k in range(1, 11)], "visit_occurrence_id long, person_id long, visit_concept_id int, visit_start_date date, visit_end_date date, provider_id long, care_site_id long"),
        "visit_note": make([(1, 1, "text")], "visit_note_id long, visit_occurrence_id long, note_text string"),
        "death": make([(p, D(2024, 6, 1), 0) for p in (14, 15)], "person_id long, death_date date, cause_concept_id int"),
        "cohort": make([(1, p, D(2021, 2, 1), D(2021, 12, 31)) for p in ids] + [(2, p, D(2022, 1, 1), D(2022, 3, 1)) for p in (1, 2, 3, 4)] + [(3, 1, D(2022, 1, 1), D(2022, 3, 1))] + [(1, 1, D(2022, 2, 1), D(2022, 12, 31))], "cohort_definition_id long, subject_id long, cohort_start_date date, cohort_end_date date"),
        "concept": make([(201820, "Diabetes mellitus", "Condition", "SNOMED", "S", "73211009"), (255573, "Lung disease", "Condition", "SNOMED", "S", "13645005"), (317009, "Asthma", "Condition", "SNOMED", "S", "195967001"), (44833365, "Retinal finding", "Condition", "ICD9CM", "", "362.01"), (45552385, "Hemiplegia", "Condition", "ICD10CM", "", "G81.9")], "concept_id int, concept_name string, domain_id string, vocabulary_id string, standard_concept string, concept_code string"),
        "concept_ancestor": make([(201820, 201820, 0), (255573, 255573, 0), (255573, 317009, 1), (317009, 317009, 0)], "ancestor_concept_id int, descendant_concept_id int, min_levels int"),
        "concept_relationship": make([(44833365, 201820, "Maps to", None), (45552385, 317009, "Maps to", None)], "concept_id_1 int, concept_id_2 int, relationship_id string, invalid_reason string"),
        "concept_synonym": make([(201820, "sugar disease")], "concept_id int, concept_synonym_name string"),
        "cdm_source": make([("Test", "v5.4.1")], "cdm_source_name string, cdm_version string"),
        "achilles_analysis": make([(2, "by gender", "gender", None, None, None, None)], "analysis_id int, analysis_name string, " + ", ".join(f"stratum_{k}_name string" for k in range(1, 6))),
        "achilles_results": make([(2, "8507", None, None, None, None, 17), (2, "8532", None, None, None, None, 2)], "analysis_id int, " + ", ".join(f"stratum_{k} string" for k in range(1, 6)) + ", count_value long"),
        "achilles_results_dist": make([(103, *[None] * 5, 12, 1.0, 99.0, *[5.0] * 7), (103, "x", *[None] * 4, 7, 1.0, 99.0, *[5.0] * 7)], "analysis_id int, " + ", ".join(f"stratum_{k} string" for k in range(1, 6)) + ", count_value long, min_value double, max_value double, " + ", ".join(f"{c} double" for c in results.DISTRIBUTION)),
        "achilles_heel_results": make([(2, "warning", 1, 5)], "analysis_id int, achilles_heel_warning string, rule_id int, record_count long"),
        "incidence_rate": make([(1, "F", "40-49", 2020, 12, 100.5, 3.2, "a"), (1, "M", "40-49", 2020, 4, 50.5, 3.2, "a"), (1, "M", "50-59", 2020, 2, 5.5, 3.2, "a")], "cohort_id long, gender string, age_group string, calendar_year int, cohort_count long, person_years double, incidence_rate double, database_id string"),
    }


@pytest.fixture(scope="module")
def session(spark, tables):
    definitions = spark.createDataFrame([(1, "all"), (2, "few")], "cohort_definition_id long, cohort_definition_name string")
    return Session(spark, tables, secret=b"test", grids={"measurement.value_as_number": [0.0, 5.0, 14.0]}, definitions=definitions)


def rows(df):
    return sorted([tuple(r) for r in df.collect()], key=repr)


def test_blueprint(tables):
    b = Blueprint(tables)
    c = b["condition_occurrence"]
    assert (c.concept_column, c.date_column, c.interval, c.key, c.category) == ("condition_concept_id", "condition_start_date", ("condition_start_date", "condition_end_date"), "condition_occurrence_id", "clinical")
    assert b["measurement"].date_column == "measurement_date" and b["measurement"].interval is None and b["person"].concept_column == "gender_concept_id" and b["death"].key == "person_id"
    assert [c.column(x).role for x in ("condition_concept_id", "condition_type_concept_id", "person_id")] == ["domain_concept", "type_concept", "non_concept"]
    assert "person_source_value" not in b.visible("person") and "year_of_birth" not in b.visible("person") and "provider_id" not in b.visible("visit_occurrence")
    assert b.filterable("condition_occurrence") == ["condition_concept_id", "condition_start_date", "condition_end_date", "condition_type_concept_id"]
    assert b.path_to_person("visit_note") == [("visit_note", "visit_occurrence_id", "visit_occurrence")] and b.path_to_person("person") == []
    assert b.with_person(tables, "visit_note").first()["person_id"] == 1
    assert b.version(tables) == "5.4" and Blueprint({k: v for k, v in tables.items() if k != "cdm_source"}).version({}) == "5.3"


def test_extract(tables):
    b = Blueprint(tables)
    info = b["condition_occurrence"]
    assert list(columns_of(info, ["condition_start_date"])) == ["person_id", "condition_concept_id", "condition_start_date"]
    assert columns_of(info, {"condition_start_date": "day"})["condition_start_date"] == "day"
    for wrong in (["no_such"], {"condition_start_date": "x", "condition_end_date": "x"}):
        with pytest.raises(SpecError):
            columns_of(info, wrong)
    with pytest.raises(SpecError):
        columns_of(b["person"], ["year_of_birth"])
    take = lambda **how: extract(tables, b, "condition_occurrence", ["condition_start_date"], **how)
    assert take(concepts=[201820]).count() == 6 and take(where={"column": "start_date", "op": "between", "value": ["2021-01-01", "2021-04-01"]}).count() == 3
    assert take(cohort=tables["cohort"].where("cohort_definition_id = 2")).count() == 4 and take(visits=[9201]).count() == 10
    assert take(select=(1, "first")).count() == 9 and take(min_gap=10_000).count() == 12 and take(limit=2).count() == 2
    assert take(dates="remove").columns == ["person_id", "condition_concept_id"]
    relative = take(cohort=tables["cohort"].where("cohort_definition_id = 1"), dates="relative").where("person_id = 1").collect()
    assert [r["condition_start_date"] for r in relative] == [(D(2021, 1, 31) - D(2021, 2, 1)).days]
    for wrong in ({"where": {"column": "condition_start_date", "op": ">", "value": "2021-01-01"}}, {"concepts": [255573, 317009][:1], "cohort": tables["cohort"].where("cohort_definition_id = 3")}, {"limit": 0}, {"dates": "relative"}):
        with pytest.raises((ValueError, DisclosureError)):
            take(**wrong)


def test_filter_rules(tables):
    b = Blueprint(tables)
    info = b["measurement"]
    assert generic_dates({"filters": [{"column": "end_date", "op": "is_null"}]}, info)["filters"][0]["column"] == "measurement_date"
    assert [classify(s, info) for s in ({"column": "measurement_concept_id", "op": "in", "value": [1]}, {"column": "measurement_date", "op": "between", "value": []}, {"column": "value_as_number", "op": "between", "value": []}, {"column": "value_as_number", "op": "value_bin", "value": [0, 5]}, {"column": "value_as_number", "op": "<", "value": 1})] == ["allowed", "constrained", "blocked", "constrained", "blocked"]
    check_bins({"filters": [{"column": "value_as_number", "op": "value_bin", "value": [5.0, 14.0]}]}, {"value_as_number": [0.0, 5.0, 14.0]})
    with pytest.raises(SpecError):
        check_bins({"column": "value_as_number", "op": "value_bin", "value": [0.0, 14.0]}, {"value_as_number": [0.0, 5.0, 14.0]})
    deep = {"column": "measurement_concept_id", "op": "is_null"}
    for _ in range(filters.MAX_DEPTH):
        deep = {"filters": [deep]}
    for spec in (deep, {"filters": [{"column": "measurement_concept_id", "op": "is_null"}] * filters.MAX_NODES}, {"column": "measurement_concept_id", "op": "in", "value": list(range(filters.MAX_VALUES + 1))}, {"column": "x; drop", "op": "is_null"}, {"column": "measurement_id", "op": "in", "value": [1]}, {"column": "measurement_concept_id", "op": "like", "value": "a"}):
        with pytest.raises(filters.FilterError):
            filters.validate(spec, tables["measurement"])
    assert filters.complexity({"filters": [{"column": "a", "op": "in", "value": [1, 2]}, {"column": "b", "op": "is_null"}]}) == (2, 3, 3)


def test_plan(spark, tables, session):
    cdm = Cdm(spark, "", dict(tables))
    plan = Plan(
        {
            "diabetic": {"kind": "events", "domain": "condition", "concepts": [201820]},
            "men": {"kind": "filter", "of": "diabetic", "filter": {"type": "sex", "value": "M"}, "policy": "any_episode"},
            "treated": {"kind": "include", "of": "diabetic", "criteria": [Criterion("drug", (1124300,))]},
            "untreated": {"kind": "combine", "op": "setdiff", "members": ["diabetic", "treated"]},
        },
        {
            "wide": {"kind": "wide", "population": "men", "domain": "measurement", "concepts": {3004410: "hba1c"}},
            "sparse": {"kind": "sparse", "population": "men", "domain": "condition"},
            "survival": {"kind": "survival", "population": "diabetic", "outcomes": [{"domain": "condition", "concepts": [255573]}], "end": 2000},
            "members": {"kind": "membership", "population": "treated"},
            "counts": {"kind": "features", "population": "men", "domain": "condition", "features": [features.Feature("n", "count"), features.Feature("lung", "boolean", (255573,))]},
            "bins": {"kind": "person_period", "population": "men", "start": 0, "end": 59, "width": 30},
        },
    )
    out = outputs.run(cdm, plan)
    assert rows(out["wide"].select("person_id", "hba1c")) == [(p, float(p)) for p in (1, 11, 3, 5, 7, 9)]
    assert rows(out["members"].select("subject_id")) == [(1,), (3,), (5,), (7,)]
    assert {tuple(r) for r in out["sparse"].where("covariate_id % 1000 = 1").select("person_id", "covariate_id").collect()} == {(p, 201820001) for p in (1, 3, 5, 7, 9, 11)} | {(p, 255573001) for p in (5, 7, 9)}
    assert [r["n"] for r in out["counts"].orderBy("person_id").collect()] == [1, 1, 2, 2, 2, 1] and out["bins"].count() == 12
    assert out["survival"].where("status = 0").count() == 6  # each episode ends before the outcome
    assert outputs.preview(plan)[0] == {"output": "wide", "kind": "wide", "population": "men"}
    few = Plan({"two": {"kind": "persons", "ids": [1, 2]}}, {"x": {"kind": "membership", "population": "two"}})
    with pytest.raises(DisclosureError):
        outputs.run(cdm, few)
    for bad in (Plan({"a": {"kind": "combine", "op": "union", "members": ["b"]}}), Plan({"a": {"kind": "nothing"}}), Plan({}, {"x": {"kind": "nothing"}}), Plan({}, {"x": {"kind": "wide", "population": "b"}})):
        with pytest.raises(SpecError):
            outputs.run(cdm, bad)
    recurs = Plan({"all": {"kind": "stored", "id": 1}, "older": {"kind": "filter", "of": "all", "filter": {"type": "age_range", "min": 30}}})
    with pytest.raises(SpecError):
        outputs.populations(cdm, recurs)
    scoped = outputs.populations(cdm, Plan({"diabetic": plan.populations["diabetic"]}, {}, tables["cohort"].where("cohort_definition_id = 2")))
    assert rows(scoped["diabetic"].select("subject_id")) == [(1,), (3,)]
    assert session.plan_execute(plan) == list(plan.outputs)
    kept = session.frames["members"].first()
    assert isinstance(kept["subject_id"], str) and rows(tokens.reverse(session.frames["members"], b"test", "subject_id").select("subject_id")) == [(1,), (3,), (5,), (7,)]


def test_releases(session):
    assert rows(session.table_stats("condition_occurrence")) == [(10, 5)]  # 12 records, 9 persons
    assert [r["n_persons"] for r in session.domain_coverage(["person", "death"]).collect()] == [15]
    assert {r["concept_id"]: (r["n_persons"], r["n_records"], r["concept_name"]) for r in session.concept_prevalence("condition_occurrence").collect()} == {201820: (5, 5, "Diabetes mellitus"), 255573: (0, 0, "Lung disease")}
    assert rows(session.date_counts("condition_occurrence")) == [("2021", 10, 5)]
    assert session.numeric_range("measurement", "value_as_number").first()["p05"] == 4.0
    assert session.safe_cutpoints("measurement", "value_as_number") == [0.0, 5.0, 14.0] and session.issued() == {"value_as_number": [0.0, 5.0, 14.0]}
    session.extract("low", "measurement", where={"column": "value_as_number", "op": "value_bin", "value": [0.0, 5.0]})
    assert session.frames["low"].count() == 4
    assert rows(session.numeric_histogram("measurement", "value_as_number", breaks=[0.0, 5.0, 14.0]).select("bin", "n_persons")) == [(0, 0), (1, 5)]
    assert set(session.drilldown("condition_occurrence", 201820)) == {"summary", "missingness", "dates", "categories"}
    assert [r["table_name"] for r in session.locate_concept([201820]).collect()] == ["condition_occurrence"]
    for closed in (lambda: session.value_counts("person", "person_source_value"), lambda: session.value_counts("person", "person_id"), lambda: session.drilldown("condition_occurrence", 317009), lambda: session.table_stats("nothing"), lambda: session.query_exec("person.load"), lambda: session.query_exec("person.year_of_birth_distribution")):
        with pytest.raises((SpecError, DisclosureError)):
            closed()
    assert [e["call"] for e in session.audit][-1] != "ping" and {"table_stats", "locate_concept"} <= {e["call"] for e in session.audit}
    assert session.ping()["ok"] and session.cdm_version() == "5.4" and session.capabilities()["version"] == "5.4" and session.cdm_source()[0]["cdm_source_name"] == "Test"
    assert {"from": "condition_occurrence", "column": "visit_occurrence_id", "to": "visit_occurrence"} in session.relationship_graph()
    assert session.disclosure_settings()["subset"] == 3 and "year_of_birth" not in {c["column"] for c in session.list_columns("person")}
    assert {t["table"] for t in session.list_tables()} >= {"person", "cohort"}


def test_session_cohorts_and_verbs(session, tables):
    assert rows(session.cohort_list().select("cohort_definition_id", "subjects", "cohort_definition_name")) == [(1, 15, "all"), (2, 0, "few")]
    assert session.cohort_definition(1)["cohort_definition_name"] == "all"
    with pytest.raises(DisclosureError):
        session.cohort_definition(3)
    session.cohort_create("diabetic", {"kind": "events", "domain": "condition", "concepts": [201820]})
    session.cohort_combine("both", "intersect", ["diabetic", 1])
    session.cohort_combine("same", "union", ["diabetic", "diabetic"])
    assert session.cohort("both").count() == session.cohort("same").count() == 6 and session.cohort(None).count() == 15
    session.extract("people", "condition_occurrence")
    session.cohort_from_table("again", "people")
    assert session.cohort("again").select("subject_id").distinct().count() == 9
    session.frames["words"] = session.frames["people"].withColumn("kind", F.when(F.col("condition_concept_id") == 201820, "sugar").otherwise("lung"))
    assert session.factor_levels("words", "kind") == ["lung", "sugar"]
    session.as_factor("two", "words", "kind", ["sugar"], "other")
    session.filter("sugar", "words", "kind", "==", "sugar")
    session.select("narrow", "words", ["kind"])
    session.bind_rows("more", ["narrow", "narrow"])
    session.extract("drugs", "drug_exposure")
    session.merge("joined", "narrow", "drugs")
    assert rows(session.frames["two"].groupBy("kind").count()) == [("other", 6), ("sugar", 6)] and session.frames["sugar"].count() == 6 and session.frames["more"].count() == 24
    with pytest.raises(DisclosureError):
        verbs.filter_rows(session.frames["words"], "kind", "==", "nothing")
    session.cleanup(["words"])
    assert "words" not in session.frames and "two" in session.frames


def test_session_vocabulary(session):
    assert rows(session.search_concepts("lung").select("concept_id")) == [(255573,)] and rows(session.lookup_concepts([317009]).select("concept_name")) == [("Asthma",)]
    assert rows(session.descendants([255573]).select("descendant_concept_id")) == [(255573,), (317009,)] and rows(session.ancestors([317009]).select("ancestor_concept_id")) == [(255573,)]
    assert rows(session.expand_concept_set(ConceptSet((255573,), include_descendants=True, include_mapped=True))) == [(255573,), (317009,), (45552385,)] and rows(session.expand_concept_set([1, 2])) == [(1,), (2,)]
    assert session.synonyms([201820]).count() == 1 and session.relationships([201820]).first()["direction"] == "reverse"
    assert session.list_concepts(0, 2, domain_id="Condition")[0] == 5 and {r[0] for r in session.vocabularies().collect()} == {"SNOMED", "ICD9CM", "ICD10CM"} and rows(session.domains()) == [("Condition",)]


def test_session_analyses(session):
    assert {"fe.prevalence", "incidence.rate"} <= set(session.analysis_list()) and session.analysis_get("incidence.rate")["unit"] == "person"
    assert rows(session.analysis_run("cohortdx.cohort_count", 1)) == [(15, 15)]
    assert session.analysis_run("fe.prevalence", 1, start=-1000, end=1000, top=1).first()["concept_id"] == 201820
    session.analysis_run_assign("kept", "fe.demographics", cohort=1)
    assert session.frames["kept"].where("kind = 'gender'").count() == 2
    for wrong in (lambda: session.analysis_run("nothing"), lambda: session.analysis_run("cohortdx.cohort_count", 1, size=3), lambda: session.analysis_run("cohortdx.cohort_count", 3)):
        with pytest.raises((SpecError, DisclosureError)):
            wrong()
    mine = Entry("mine.count", "person", lambda s, c, p: c.groupBy().agg(F.countDistinct("subject_id").alias("n_persons")).withColumn("ids", F.lit(1)), ("n_persons",), columns=("n_persons",))
    session.register(mine)
    with pytest.raises(DisclosureError):
        session.analysis_run("mine.count", 1)  # it gives a column that it did not declare
    with pytest.raises(SpecError):
        session.register(mine)
    with pytest.raises(SpecError):
        session.register(Entry("mine.rows", "record", mine.compute, ("n",), columns=("n",)))
    assert rows(session.standard_analysis(2)) == [(8507, 5), (8532, 5)] and len(session.query_list()) == 80
    assert session.query_get("person.demographic_summary")["safety"] == "SAFE_AGGREGATE" and session.achilles_catalog()[0]["analysis_id"] == 1
    assert rows(session.score("chads2", 2050).select("score", "n_persons")) == [(0.0, 5), (1.0, 5), (2.0, 0)]


#: One of each kind, and those that no registered query has.
GATED = (
    "char.dechallenge_rechallenge", "char.risk_factor_smd", "char.target_covariates", "cm.attrition", "cm.covariate_balance", "cm.effect_estimate", "cm.kaplan_meier", "cm.mdrr", "cohortdx.time_series", "fe.demographics",
    "plp.calibration", "plp.performance", "sccs.incidence_rate_ratio", "txpath.pathways", "es.diagnostics",
)


def test_registered_analyses_are_gated(spark):
    """They run on the views under their own defaults, and no count that leaves is small or unbanded."""
    views = Session(spark, Cdm(spark, "/root/testdata/sf0.001"), secret=b"test")
    for name in GATED:
        e = views.registry[name]
        found = views.analysis_run(name, 2).collect()
        for row in found:
            assert all(row[c] % 5 == 0 for c in (*e.counts, *([e.companion] if e.companion else []))), (name, row)
        assert name not in ("fe.demographics", "cm.attrition", "cohortdx.time_series", "plp.performance") or found
    with pytest.raises(DisclosureError):
        views.analysis_run("fe.demographics", cohort=99)


def test_precomputed_results(session):
    assert all(session.achilles_status().values()) and session.achilles_analyses().count() == 1
    assert rows(session.achilles_results([2]).select("stratum_1", "count_value")) == [("8507", 15)] and session.achilles_results([2], ["8532"]).count() == 0
    found = session.achilles_distribution([103]).orderBy("count_value").collect()
    assert [r["avg_value"] for r in found] == [None, 5.0] and "min_value" not in found[0].asDict()
    assert session.achilles_warnings().columns == ["analysis_id", "achilles_heel_warning", "rule_id"]
    assert session.tool_tables() == [("CohortDiagnostics", "incidence_rate")] and session.tool_status() == {"CohortDiagnostics": ["incidence_rate"]}
    got = session.tool_results("incidence_rate", gender="M").collect()
    assert [(r["cohort_count"], r["incidence_rate"]) for r in got] == [(0, None)] and session.tool_contract("incidence_rate")["tool"] == "CohortDiagnostics" and session.tool_summary()[0]["table"] == "incidence_rate"
    with pytest.raises(ValueError):
        session.tool_results("person")
    with pytest.raises(ValueError):
        session.tool_results("incidence_rate", cohort_count=2)


def test_scores(spark, tables):
    cdm = Cdm(spark, "", dict(tables))
    assert rows(features.score(cdm, scores.CHARLSON, 2024).where("score > 0").select("person_id")) == [(1,), (11,), (3,), (5,), (7,), (9,)]
    vasc = {r["person_id"]: r["score"] for r in features.score(cdm, scores.CHA2DS2_VASC, 2040).collect()}
    assert vasc[1] == 1 + 2 and vasc[2] == 2 + 1 and vasc[15] == 0
    codes = tables["concept"].where("vocabulary_id like 'ICD%'").select("concept_id", "concept_code")
    dcsi = {r["person_id"]: r["score"] for r in scores.code_score(cdm, scores.DCSI, codes).collect()}
    frail = {r["person_id"]: r["score"] for r in scores.code_score(cdm, scores.HFRS, codes).collect()}
    assert {p for p, s in dcsi.items() if s == 1.0} == {1, 3, 5, 7, 9, 11} and {p for p, s in frail.items() if s == 4.4} == {2, 4} and len(scores.FRAILTY) == 109
    assert {r["subject_id"]: r["score"] for r in scores.component_index(cdm, tables["cohort"], [255573, 201820, 99]).collect()}[5] == 2


def test_staging(spark, session, tmp_path):
    session.frames["plain"] = spark.createDataFrame([(1, "a"), (2, None)], "k long, word string")
    for form in ("parquet", "csv"):
        manifest = session.stage("plain", f"{tmp_path}/{form}", form, {"grain": "row"})
        assert manifest["rows"] == 2 and rows(sinks.read_output(spark, f"{tmp_path}/{form}", {"grain": "row"})) == rows(session.frames["plain"])
        assert session.staged_dataset_path(str(tmp_path), form, {"grain": "row"}) == f"{tmp_path}/{form}"
    for wrong in (lambda: session.stage("plain", f"{tmp_path}/csv"), lambda: sinks.read_output(spark, f"{tmp_path}/csv", {"grain": "person"}), lambda: session.staged_dataset_path(str(tmp_path), "../csv"), lambda: sinks.staged_path(spark, str(tmp_path), "csv", now=4e9), lambda: session.staged_dataset_path(str(tmp_path), "csv", {})):
        with pytest.raises((ValueError, FileExistsError)):
            wrong()
    for quota in ({"max_rows": 1}, {"max_bytes": 10}):
        with pytest.raises(sinks.QuotaError):
            sinks.write_output(session.frames["plain"], f"{tmp_path}/over", **quota)
    assert not [p for p in tmp_path.iterdir() if p.name.startswith("over")]
    assert sinks.drop_stale(spark, str(tmp_path), now=4e9) == ["csv", "parquet"] and not [p for p in tmp_path.iterdir() if not p.name.startswith(".")]
    sinks.write_cohort(spark.createDataFrame([(1,)], "subject_id long"), f"{tmp_path}/cohorts", 1)
    sinks.write_cohort(spark.createDataFrame([(2,)], "subject_id long"), f"{tmp_path}/cohorts", 2)
    sinks.write_cohort(spark.createDataFrame([(3,)], "subject_id long"), f"{tmp_path}/cohorts", 1)
    assert rows(spark.read.parquet(f"{tmp_path}/cohorts")) == [(2, 2), (3, 1)]


def test_noise_is_keyed_and_bounded(session):
    one = session.noise_release("count", "condition_occurrence").first()["value"]
    assert one == session.noise_release("count", "condition_occurrence").first()["value"]
    draws = [noise.discrete_laplace(b"k", {"q": k}, "v", 1.0) for k in range(4000)]
    assert abs(sum(draws) / 4000) < 0.1 and abs(sum(d * d for d in draws) / 4000 - 1.84) < 0.3  # variance 2q / (1 - q)^2
    assert noise.noisy(b"k", {}, "v", 0, 0.01) >= 0 and noise.noisy(b"k", {}, "v", noise.MAX_INTEGER, 0.01) <= noise.MAX_INTEGER
    means = session.noise_release("bounded_mean", "measurement", "value_as_number", low=0.0, high=20.0)
    assert means.columns == ["n", "total"] and session.noise_status()["epsilon"] == 0.1
    levels = session.noise_release("categorical_histogram", "condition_occurrence", "condition_concept_id", levels=[201820, 5])
    assert levels.count() == 2
    with pytest.raises(SpecError):
        session.noise_release("median", "measurement")


def test_date_breaks_and_seals(spark, session):
    assert noise.break_numbers(["1970-01-02", "1970-02-01"], "date") == [1.0, 31.0] and noise.break_numbers(["1970-01-01T00:01:00", "1970-01-02"], "datetime") == [60.0, 86400.0]
    with pytest.raises(ValueError):
        noise.break_numbers([1, 1], "number")
    bins = noise.date_histogram(session._tables["condition_occurrence"], "condition_start_date", ["2021-01-01", "2021-06-01", "2022-12-31"]).orderBy("bin").collect()
    assert [r["value"] for r in bins] == [5, 4]
    assert session.noise_release("date_histogram", "condition_occurrence", "condition_start_date", breaks=["2021-01-01", "2021-06-01", "2022-12-31"]).count() == 2
    session.frames["rows"] = spark.createDataFrame([(1, 2.0), (2, 3.0)], "person_id long, x double")
    proof = session.seal("rows", {"kind": "rows"})
    session.frames["rows"] = session.frames["rows"].orderBy(F.desc("x"))
    assert session.verify("rows", {"kind": "rows"}, proof) and not session.verify("rows", {"kind": "other"}, proof)
    session.frames["rows"] = session.frames["rows"].withColumn("x", F.col("x") + 1)
    assert not session.verify("rows", {"kind": "rows"}, proof)
    assert {"table": "measurement", "column": "value_as_number", "statistic": "bounded_mean"} in session.noise_catalog() and not [x for x in session.noise_catalog() if x["column"] == "year_of_birth"]


def test_temporal_specs(spark, tables):
    from tidewell.operators import temporal

    for bad in ({"nothing": 1}, {"index_window": (5, 1)}, {"event_select": {"order": "middle"}}, {"min_gap": 0}):
        with pytest.raises(ValueError):
            temporal.check_spec(bad)
    for bad in ((5, 1, 1), (0, 10, 0), (0, 20_000, 1)):
        with pytest.raises(ValueError):
            temporal.check_bins(*bad)
    assert temporal.check_bins(0, 59, 30) == 2
    whole = tables["cohort"].where("cohort_definition_id = 2")
    assert temporal.roster(whole, tables["observation_period"]).count() == 4
    with pytest.raises(ValueError):
        temporal.roster(whole.withColumn("cohort_start_date", F.lit("1999-01-01").cast("date")), tables["observation_period"])
    assert rows(features.declared_dictionary(spark, {7: "Blood pressure, high"})) == [(7, "Blood pressure, high", "blood_pressure_high")]


def test_tokens(spark):
    df = spark.createDataFrame([(1, 1), (2, 1), (1, 2), (None, 3)], "person_id long, n int")
    hidden = tokens.tokenise(df, b"secret")
    assert hidden.select("person_id").distinct().count() == 3 and rows(tokens.reverse(hidden, b"secret")) == rows(df)
    assert tokens.tokenise(df, b"other").where("n = 1").first()["person_id"] != hidden.where("n = 1").first()["person_id"]


def test_complementary_suppression(spark):
    assert gate.complementary([[10, 2], [20, 30]], 3) == [[None, None], [None, None]]
    assert gate.complementary([[0, 5], [6, 7]], 3) == [[None, 5], [6, 7]]
    assert gate.complementary([[2, 5, 9], [6, 7, 1], [8, 8, 8]], 3) == [[None, None, 9], [None, None, None], [None, 8, None]]
    cells = [(f"r{r}", f"c{c}", n) for r, line in enumerate([[12, 2], [20, 31]]) for c, n in enumerate(line)]
    people = [(k, r, c) for k, (r, c) in enumerate((r, c) for r, c, n in cells for _ in range(n))]
    df = spark.createDataFrame(people, "person_id long, a string, b string")
    assert {r["n_persons"] for r in profile.crosstab(df, "a", "b", Policy()).collect()} == {None}
    with pytest.raises(ValueError):
        profile.crosstab(df, "person_id", "b", Policy())
    assert profile.crosstab(df, "a", "b").where("row = 'r0' and col = 'c1'").first()["n_persons"] == 2


def test_pooling_and_text_limits(spark, session):
    policy = Policy(tab=1, band=1, text=5)
    one, two = (spark.createDataFrame(x, "k string, n_with long, n_persons long") for x in ([("a", 5, 10), ("toolong", 6, 12)], [("a", 1, 30), ("b", 2, 4)]))
    ratios = {"share": ("n_with", "n_persons")}
    released = [gate.gate(x.withColumn("share", F.lit(0.0)).withColumn("suppressed", F.lit(False)), "person", ["n_with", "n_persons"], policy, ratios=ratios) for x in (one, two)]
    assert rows(released[0].select("k")) == [("a",), (None,)]
    contract = gate.pooling_contract("person", ["n_with", "n_persons"], ratios, ["k"])
    assert {r["k"]: (r["n_with"], r["n_persons"], r["share"]) for r in gate.pooled(released, contract).collect()} == {"a": (6, 40, 0.15), None: (6, 12, 0.5), "b": (2, 4, 0.5)}
    assert session.pooling_contract("incidence.rate") == {"n_with_outcome": "sum", "n_persons": "sum", "proportion": "n_with_outcome / n_persons"}


def test_ties_and_reference(spark):
    sets = spark.createDataFrame([(1, D(2020, 1, 1), D(2020, 3, 1), D(2020, 1, 1), D(2020, 3, 1))], "subject_id long, cohort_start_date date, cohort_end_date date, entry date, exit date")
    ev = spark.createDataFrame([(1, 8, D(2020, 1, 5)), (1, 9, D(2020, 1, 5)), (1, 8, D(2020, 2, 5))], "person_id long, outcome long, event_date date")
    risk = survival.Risk()
    assert [tuple(r) for r in survival.competing_risk(sets, ev, [9, 8], risk).select("status", "time").collect()] == [(1, 4)]
    assert rows(survival.competing_risk(sets, ev, [9, 8], risk, "all").select("status", "time")) == [(1, 4), (2, 4)]
    with pytest.raises(ValueError):
        survival.competing_risk(sets, ev, [9, 8], risk, "error")
    states, edges = survival.transition_graph([("a", "b"), ("b", "a")])
    assert rows(survival.transition_reference(spark, states, edges).select("from_name", "to_name")) == [("a", "b"), ("b", "a")]
    walked = survival.multi_state(sets, spark.createDataFrame([(1, "b", D(2020, 1, 11)), (1, "a", D(2020, 1, 11)), (1, "b", D(2020, 2, 1))], "person_id long, state string, event_date date"), states, edges, "a")
    # On one day a comes before b, by half a day: a can't follow a, so b is entered then, and left for nothing.
    assert [(r["from_state"], r["to_state"], r["start"], r["stop"], r["status"]) for r in walked.orderBy("start").collect()] == [(1, 2, 0.0, 10.5, 1), (2, 1, 10.5, 60.0, 0)]
    assert dict(survival.exact_times(walked).dtypes)["stop"] == "decimal(20,9)"


def test_transition_graph():
    assert survival.transition_graph([("a", "b"), ("b", "c"), ("a", "c")]) == (["a", "b", "c"], [(1, 2), (1, 3), (2, 3)])
    with pytest.raises(ValueError):
        survival.transition_graph([("a", "a")])
