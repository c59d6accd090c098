"""Registered clinical queries against their SQL, run by DuckDB on the same tables."""

import math
import os

import duckdb
import pytest

from tidewell.queries import all_queries

SF = "/root/testdata/sf0.001"
CHOSEN = (
    "condition_prevalence_by_concept", "condition_comorbidity", "measurement_value_stats", "analysis_106", "filter_tree", "temporal_min_gap", "temporal_intervals_nearest", "cohort_union",
    "population_first_episode", "features_wide", "survival_competing_risk", "profile_prevalence_gated", "vocabulary_expand", "noise_bounded_records", "incidence_rate",
)

#: Iterative fits, and a tree of paths that is cut layer by layer: tests/test_analyses.py has small cases of them.
NO_SQL = ["cm_cox", "cm_propensity", "sccs_irr", "txpath_gated"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{name}'")
    return con


def plain(value):
    """Numbers as floats, so that both engines' number types compare; others as text."""
    if value is None or isinstance(value, float) and math.isnan(value):
        return None
    try:
        return round(float(value), 6)
    except (TypeError, ValueError):
        return str(value)


def rows(columns, values):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(columns), sorted((tuple(plain(r[k]) for k in order) for r in values), key=repr)


@pytest.mark.parametrize("name", CHOSEN)
def test_matches_sql(spark, duck, name):
    query, sql = all_queries()[name]
    got = query(spark, SF)
    want = duck.execute(sql)
    columns = [d[0] for d in want.description]
    names, ours = rows(got.columns, got.collect())
    expected_names, theirs = rows(columns, want.fetchall())
    assert names == expected_names and len(ours) == len(theirs)
    for a, b in zip(ours, theirs):
        assert all(x == y or isinstance(x, float) and isinstance(y, float) and math.isclose(x, y, rel_tol=1e-6, abs_tol=1e-6) for x, y in zip(a, b)), (a, b)


def test_every_query_has_sql_or_is_known():
    assert sorted(name for name, (_, sql) in all_queries().items() if not sql) == NO_SQL
