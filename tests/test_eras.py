"""Eras: how their table's rows are dealt out, and queries over them against their SQL."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from tests.test_queries import SF, duck, rows  # noqa: F401
from tidewell.plans.templates import catalog
from tidewell.queries import all_queries
from tidewell.sources import cdm as source
from tidewell.sources.cdm import Cdm


def agrees(spark, duck, name):  # noqa: F811
    query, sql = all_queries()[name]
    got, want = query(spark, SF), duck.execute(sql)
    names, ours = rows(got.columns, got.collect())
    expected, theirs = rows([d[0] for d in want.description], want.fetchall())
    assert names == expected and len(ours) == len(theirs) > 0
    for a, b in zip(ours, theirs):
        assert all(x == y or isinstance(x, float) and isinstance(y, float) and math.isclose(x, y, rel_tol=1e-6, abs_tol=1e-6) for x, y in zip(a, b)), (a, b)


@pytest.mark.parametrize("era, summed", [("drug_era", "drug_exposure_count"), ("condition_era", "condition_occurrence_count")])
def test_a_task_sums_few_rows_whatever_the_input(spark, monkeypatch, era, summed):
    monkeypatch.setattr(source, "TASK_ROWS", 100, raising=False)
    cdm = Cdm(spark, SF)
    tasks = cdm.table(era).groupBy(F.spark_partition_id()).agg(F.sum(summed).alias("n")).collect()
    assert sum(r["n"] for r in tasks) == cdm.table({"drug_era": "drug_exposure", "condition_era": "condition_occurrence"}[era]).count()
    assert max(r["n"] for r in tasks) <= 3 * 100


def test_given_exposures_are_not_counted_ahead(spark):
    day = dt.date(2020, 1, 1)
    made = spark.createDataFrame([(1, 5, day, day), (1, 5, day, dt.date(2020, 2, 1)), (2, 5, day, day), (None, 5, day, None)], "person_id long, drug_concept_id long, drug_exposure_start_date date, drug_exposure_end_date date")
    eras = Cdm(spark, "/nowhere", {"drug_exposure": made}).drug_era
    assert sorted(map(repr, map(tuple, eras.collect()))) == sorted(map(repr, [(1, 5, day, dt.date(2020, 2, 1), 2), (2, 5, day, day, 1), (None, 5, day, None, 1)]))


@pytest.mark.parametrize("name", ["drug_era_exposure_count_stats", "condition_era_length_stats"])
def test_eras_in_many_tasks_match_sql(spark, duck, monkeypatch, name):  # noqa: F811
    monkeypatch.setattr(source, "TASK_ROWS", 100, raising=False)
    agrees(spark, duck, name)


def distinct_again(df):
    """Whether persons are made distinct once more after the eras."""
    return "count(distinct " in df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name", ["drug_era_length_stats", "condition_era_length_stats"])
def test_statistics_of_eras_keep_no_second_table_of_persons(spark, duck, name):  # noqa: F811
    assert not distinct_again(all_queries()[name][0](spark, SF))
    agrees(spark, duck, name)


def test_statistics_of_given_eras_count_a_person_once(spark):
    day = dt.date(2020, 1, 1)
    eras = spark.createDataFrame([(1, 5, day, day, 1), (1, 5, day, day, 4), (2, 5, day, day, 1), (None, 5, day, day, 2), (1, 0, day, day, 1), (1, None, day, day, 1)], "person_id long, drug_concept_id long, drug_era_start_date date, drug_era_end_date date, drug_exposure_count long")
    concepts = spark.createDataFrame([(5, "five")], "concept_id long, concept_name string")
    got = catalog()["drug_era.exposure_count_stats"].build(Cdm(spark, "/nowhere", {"drug_era": eras, "concept": concepts})).collect()
    assert [(r["drug_concept_id"], r["n_persons"], r["n_eras"], r["avg_exposure_count"]) for r in got] == [(5, 2, 4, 2.0)]


def test_months_of_eras_keep_no_second_table_of_persons(spark, duck, monkeypatch):  # noqa: F811
    monkeypatch.setattr(source, "TASK_ROWS", 100, raising=False)
    assert not distinct_again(all_queries()["drug_era_by_month"][0](spark, SF))
    agrees(spark, duck, "drug_era_by_month")


@pytest.mark.parametrize("name", ["drug_era_prevalence_by_concept", "condition_era_prevalence_by_concept"])
def test_prevalence_of_eras_keeps_no_second_table_of_persons(spark, duck, monkeypatch, name):  # noqa: F811
    monkeypatch.setattr(source, "TASK_ROWS", 100, raising=False)
    assert not distinct_again(all_queries()[name][0](spark, SF))
    agrees(spark, duck, name)
