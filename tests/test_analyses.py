"""Fits and areas against plain versions on small cases, and the cut of pathway trees."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tidewell.functions.running import running_sums, summary, values_at
from tidewell.plans import analyses, population


def best(loss, low=-6.0, high=6.0):
    """Where a function of one number is least, by golden sections."""
    g = (math.sqrt(5) - 1) / 2
    a, b = low, high
    for _ in range(200):
        c, d = b - g * (b - a), a + g * (b - a)
        a, b = (a, d) if loss(c) < loss(d) else (c, b)
    return (a + b) / 2


def efron(rows, beta):
    """Negative partial log-likelihood of (treated, time, event) rows, ties after Efron."""
    out = 0.0
    for t in {r[1] for r in rows if r[2]}:
        risk = [math.exp(beta * r[0]) for r in rows if r[1] >= t]
        dead = [r for r in rows if r[1] == t and r[2]]
        tied = sum(math.exp(beta * r[0]) for r in dead)
        out -= beta * sum(r[0] for r in dead)
        out += sum(math.log(sum(risk) - k / len(dead) * tied) for k in range(len(dead)))
    return out


def test_cox(spark):
    rng = random.Random(2)
    for _ in range(3):
        rows = [(k % 2, rng.randint(1, 12), int(rng.random() < 0.6)) for k in range(60)]
        got = analyses.cox(spark.createDataFrame(rows, "treated long, time long, event long"))
        assert math.isclose(got["log_hr"], best(lambda b: efron(rows, b)), abs_tol=1e-6)
        h = 1e-4
        info = (efron(rows, got["log_hr"] + h) - 2 * efron(rows, got["log_hr"]) + efron(rows, got["log_hr"] - h)) / h**2
        assert math.isclose(got["se"], 1 / math.sqrt(info), rel_tol=1e-3) and got["low"] < got["hr"] < got["high"]
    assert analyses.cox(spark.createDataFrame([(1, 3, 0), (0, 4, 0)], "treated long, time long, event long")) is None


def test_conditional_ratio(spark):
    rng = random.Random(3)
    rows = [(k, n := rng.randint(1, 4), rng.randint(0, n), rng.randint(100, 400), rng.randint(10, 90)) for k in range(80)]
    got = analyses.conditional_irr(spark.createDataFrame(rows, "subject_id long, events long, exposed_events long, days long, exposed_days long"))

    def loss(b):
        return -sum(x * math.log(p := math.exp(b) * e / (math.exp(b) * e + d - e)) + (n - x) * math.log(1 - p) for _, n, x, d, e in rows)

    assert math.isclose(got["log_irr"], best(loss), abs_tol=1e-6)
    assert analyses.conditional_irr(spark.createDataFrame([(1, 1, 0, 100, 10)], "subject_id long, events long, exposed_events long, days long, exposed_days long")) is None


def test_poisson_ratio_and_detectable_risk():
    got = analyses.poisson_ratio(30, 1000, 20, 1500)
    assert math.isclose(got["rr"], 2.25) and math.isclose(got["se"], math.sqrt(1 / 30 + 1 / 20)) and analyses.poisson_ratio(0, 1, 1, 1) is None
    assert math.isclose(analyses.mdrr(50, 50, 100), math.exp((1.959963984540054 + 0.8416212335729143) * math.sqrt(1 / 25)), rel_tol=1e-9) and analyses.mdrr(0, 5, 5) is None


def test_areas(spark):
    rng = random.Random(4)
    rows = [(rng.randint(0, 15) / 16, int(rng.random() < 0.4)) for _ in range(120)]
    df = spark.createDataFrame(rows, "score double, label long")
    good, bad = ([s for s, y in rows if y == k] for k in (1, 0))
    wins = sum((a > b) + (a == b) / 2 for a in good for b in bad)
    assert math.isclose(analyses.auroc(df).first()[0], wins / len(good) / len(bad), abs_tol=1e-6)
    area, before, taken, hits = 0.0, None, 0, 0
    for s in sorted({s for s, _ in rows}, reverse=True):
        here = [y for x, y in rows if x == s]
        taken, hits = taken + len(here), hits + sum(here)
        area += sum(here) / len(good) * ((hits / taken if before is None else before) + hits / taken) / 2
        before = hits / taken
    assert math.isclose(analyses.auprc(df).first()[0], area, abs_tol=1e-6)
    assert analyses.thresholds(df).where("threshold = 0.5").first()["tp"] == sum(s >= 0.5 for s in good)
    assert analyses.calibration(df).agg(F.sum("n")).first()[0] == 120


def test_running_sums_and_ranks(spark):
    rng = random.Random(5)
    values = [rng.randint(0, 300) for _ in range(2000)]
    df = spark.createDataFrame([(float(v),) for v in values], "x double").repartition(5)
    assert values_at(df, "x", [0, 1000, 1999]) == [sorted(values)[k] for k in (0, 1000, 1999)]
    sums = running_sums(df.groupBy("x").agg(F.count(F.lit(1)).alias("n")), "x", ["n"])
    assert all(r["before_n"] == sum(v < r["x"] for v in values) for r in sums.collect())


def test_summary_by_group(spark):
    import numpy as np

    rng = random.Random(6)
    rows = [(rng.choice(["a", "b", None]), rng.choice([None, *(rng.gauss(0, 10) for _ in range(3))])) for _ in range(900)] + [("one", 4.0)]
    df = spark.createDataFrame(rows, "g string, x double").repartition(7)
    got = {r["g"]: r for r in summary(df, "x", [0.1, 0.5, 0.9], ["g"]).collect()}
    for g in ("a", "b", None, "one"):
        x = np.array([v for k, v in rows if k == g and v is not None])
        assert got[g]["n"] == len(x) and math.isclose(got[g]["mean"], x.mean(), rel_tol=1e-9)
        assert np.allclose([got[g][f"q{k}"] for k in range(3)], np.quantile(x, [0.1, 0.5, 0.9])) and (len(x) == 1) == (got[g]["sd"] is None)
        assert len(x) == 1 or math.isclose(got[g]["sd"], x.std(ddof=1), rel_tol=1e-9)
    assert summary(df.limit(0), "x", [0.5]).first()["n"] == 0


@pytest.mark.parametrize("least, want", [
    (3, {(1, "a", 12), (1, "b", 4), (1, "Other", 3), (2, "a>b", 7), (2, "a>Other", 4)}),
    (5, {(1, "a", 12), (1, "Other", 7), (2, "a>b", 7)}),
])
def test_gated_pathways(spark, least, want):
    paths = [("a>b", 5), ("a>b>a", 2), ("a>c", 2), ("a>d", 2), ("a", 1), ("b>a", 2), ("b", 2), ("c", 2), ("d>a", 1)]
    df = spark.createDataFrame(paths, "path string, n_subjects long")
    assert {tuple(r) for r in population.gated_pathways(df, least, 3).collect()} == want


def test_propensity(spark):
    day = F.to_date(F.lit("2020-01-01"))
    people = spark.range(400).select(F.col("id").alias("subject_id"), day.alias("cohort_start_date"), day.alias("cohort_end_date"))
    target, other = people.where("subject_id % 4 = 0"), people.where("subject_id % 4 <> 0")
    ev = people.where("subject_id % 4 = 0 and subject_id % 3 <> 0 or subject_id % 8 = 1").select(F.col("subject_id").alias("person_id"), F.lit(7).cast("long").alias("concept_id"), F.date_sub(day, 5).alias("event_date"))
    got = analyses.propensity(target, other, ev)
    assert got.count() == 400 and analyses.auroc(got).first()[0] > 0.7
    # One binary covariate: the fitted score is the share of the target in each group.
    groups = {(r["x"], round(r["score"], 3)) for r in got.join(ev.select(F.col("person_id").alias("subject_id"), F.lit(1).alias("x")), "subject_id", "left").select(F.coalesce("x", F.lit(0)).alias("x"), "score").distinct().collect()}
    n1 = 66 + 50
    assert all(math.isclose(s, 66 / n1 if x else 34 / 284, abs_tol=0.01) for x, s in groups)
