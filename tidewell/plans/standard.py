"""Standard characterisation analyses by numeric id, as DataFrame plans with SQL twins.

Counts of persons and records come as (stratum_1, stratum_2, count_value
[, n_persons]); distributions as one row a stratum with count, mean, standard
deviation and interpolated quantiles over one value a person.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import day_diff, floor_bin, month_key
from ..functions.running import summary
from ..sources.cdm import Cdm
from .templates import DOMAINS

#: A column made when a session is there, and with its SQL.
Lazy = Callable[[], Column]
Pair = tuple[Lazy, str]
QUANTILES = {"p10_value": 0.1, "p25_value": 0.25, "median_value": 0.5, "p75_value": 0.75, "p90_value": 0.9}


@dataclass(frozen=True)
class Analysis:
    """One analysis: what a row counts (person, record, dist), its plan and its SQL."""

    id: int
    unit: str
    build: Callable[[Cdm], DataFrame]
    sql: str

    @property
    def name(self) -> str:
        return f"analysis_{self.id}"


def distribution(df: DataFrame, value: str, *strata: str) -> DataFrame:
    """count, mean, sample standard deviation and type-7 quantiles of a column, by strata."""
    found = summary(df, value, list(QUANTILES.values()), strata)
    return found.select(*strata, F.col("n").alias("count_value"), F.round("mean", 6).alias("avg_value"), F.round("sd", 6).alias("stdev_value"), *[F.round(f"q{k}", 6).alias(n) for k, n in enumerate(QUANTILES)])


def distribution_sql(source: str, value: str, *strata: str) -> str:
    """The same in SQL."""
    listed = "".join(f"{s}, " for s in strata)
    quantiles = ", ".join(f"round(quantile_cont(CAST({value} AS DOUBLE), {q}), 6) AS {n}" for n, q in QUANTILES.items())
    return f"SELECT {listed}count({value}) AS count_value, round(avg({value}), 6) AS avg_value, round(stddev_samp({value}), 6) AS stdev_value, {quantiles} FROM ({source}) WHERE {value} IS NOT NULL" + (f" GROUP BY {', '.join(strata)}" if strata else "")


def _persons(id_: int, table: str, **strata: Pair) -> Analysis:
    """Distinct persons by strata."""
    build = lambda cdm: cdm.table(table).groupBy(*[c().alias(n) for n, (c, _) in strata.items()]).agg(F.countDistinct("person_id").alias("count_value"))
    return Analysis(id_, "person", build, f"SELECT {''.join(f'{s} AS {n}, ' for n, (_, s) in strata.items())}count(DISTINCT person_id) AS count_value FROM {table}" + (" GROUP BY ALL" if strata else ""))


def _records(id_: int, table: str, **strata: Pair) -> Analysis:
    """Records, with the persons behind them, by strata."""
    build = lambda cdm: cdm.table(table).groupBy(*[c().alias(n) for n, (c, _) in strata.items()]).agg(F.count(F.lit(1)).alias("count_value"), F.countDistinct("person_id").alias("n_persons"))
    return Analysis(id_, "record", build, f"SELECT {''.join(f'{s} AS {n}, ' for n, (_, s) in strata.items())}count(*) AS count_value, count(DISTINCT person_id) AS n_persons FROM {table} GROUP BY ALL")


def _col(name: str) -> Pair:
    return (lambda: F.col(name)), name


def _month(name: str) -> Pair:
    return (lambda: month_key(F.col(name))), f"year({name}) * 100 + month({name})"


def first_period(cdm: Cdm) -> DataFrame:
    """Each person's first observation period, with sex and birth year."""
    first = Window.partitionBy("person_id").orderBy("observation_period_start_date", "observation_period_id")
    period = cdm.observation_period.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
    return period.join(cdm.person.select("person_id", "gender_concept_id", "year_of_birth"), "person_id")


_FIRST = "(SELECT o.*, p.gender_concept_id, p.year_of_birth FROM (SELECT *, row_number() OVER (PARTITION BY person_id ORDER BY observation_period_start_date, observation_period_id) AS k FROM observation_period) o JOIN person p ON p.person_id = o.person_id WHERE k = 1)"


def _first_age() -> Pair:
    born = lambda: F.make_date(F.col("year_of_birth").cast("int"), F.lit(1), F.lit(1))
    return (lambda: F.floor(day_diff(F.col("observation_period_start_date"), born()) / 365).cast("long")), "CAST(floor(date_diff('day', make_date(year_of_birth, 1, 1), observation_period_start_date) / 365) AS BIGINT)"


def _periods() -> list[Analysis]:
    years = lambda: F.year("observation_period_start_date") - F.col("year_of_birth")
    years_sql = "(year(observation_period_start_date) - year_of_birth)"
    length = lambda: day_diff(F.col("observation_period_end_date"), F.col("observation_period_start_date"))
    length_sql = "date_diff('day', observation_period_start_date, observation_period_end_date)"
    age, age_sql = _first_age()
    decile, decile_sql = (lambda: floor_bin(years(), 10)), f"CAST(floor({years_sql} / 10) * 10 AS BIGINT)"
    band, band_sql = (lambda: floor_bin(years(), 5)), f"CAST(floor({years_sql} / 5) * 5 AS BIGINT)"

    def counts(id_: int, **strata: Pair) -> Analysis:
        return Analysis(id_, "person", lambda cdm: first_period(cdm).groupBy(*[c().alias(n) for n, (c, _) in strata.items()]).agg(F.countDistinct("person_id").alias("count_value")), f"SELECT {''.join(f'{s} AS {n}, ' for n, (_, s) in strata.items())}count(DISTINCT person_id) AS count_value FROM {_FIRST} GROUP BY ALL")

    def dist(id_: int, value: Lazy, value_sql: str, **strata: Pair) -> Analysis:
        return Analysis(id_, "dist", lambda cdm: distribution(first_period(cdm).select(*[c().alias(n) for n, (c, _) in strata.items()], value().alias("v")), "v", *strata), distribution_sql(f"SELECT {''.join(f'{s} AS {n}, ' for n, (_, s) in strata.items())}{value_sql} AS v FROM {_FIRST}", "v", *strata))

    def observed(cdm: Cdm) -> DataFrame:
        year = F.explode(F.sequence(F.year("observation_period_start_date").cast("long"), F.year("observation_period_end_date").cast("long")))
        return cdm.observation_period.select("person_id", year.alias("stratum_1")).groupBy("stratum_1").agg(F.countDistinct("person_id").alias("count_value"))

    return [
        counts(101, stratum_1=(band, band_sql)),
        counts(102, stratum_1=_col("gender_concept_id"), stratum_2=(band, band_sql)),
        dist(103, age, age_sql),
        dist(104, age, age_sql, stratum_1=_col("gender_concept_id")),
        dist(105, length, length_sql),
        dist(106, length, length_sql, stratum_1=_col("gender_concept_id")),
        dist(107, length, length_sql, stratum_1=(decile, decile_sql)),
        counts(108, stratum_1=((lambda: floor_bin(length(), 30)), f"CAST(floor({length_sql} / 30) * 30 AS BIGINT)")),
        Analysis(109, "person", observed, "SELECT y AS stratum_1, count(DISTINCT person_id) AS count_value FROM (SELECT person_id, unnest(range(year(observation_period_start_date), year(observation_period_end_date) + 1)) AS y FROM observation_period) GROUP BY y"),
        Analysis(113, "person", lambda cdm: cdm.observation_period.groupBy("person_id").agg(F.count(F.lit(1)).alias("stratum_1")).groupBy("stratum_1").agg(F.count(F.lit(1)).alias("count_value")), "SELECT k AS stratum_1, count(*) AS count_value FROM (SELECT person_id, count(*) AS k FROM observation_period GROUP BY person_id) GROUP BY k"),
    ]


def _domain(base: int, domain: str, months_id: int) -> list[Analysis]:
    d = DOMAINS[domain]
    concept, month = _col(d.concept), _month(d.start)

    def ages(cdm: Cdm) -> DataFrame:
        first = cdm.table(d.table).groupBy(d.concept, "person_id").agg(F.min(d.start).alias("first"))
        v = (F.year("first") - F.col("year_of_birth")).cast("long")
        return distribution(first.join(cdm.person.select("person_id", "year_of_birth"), "person_id").select(F.col(d.concept).alias("stratum_1"), v.alias("v")), "v", "stratum_1")

    def per_person(cdm: Cdm) -> DataFrame:
        return distribution(cdm.table(d.table).groupBy("person_id").agg(F.countDistinct(d.concept).alias("v")), "v")

    out = [
        _persons(base, d.table, stratum_1=concept),
        _records(base + 1, d.table, stratum_1=concept),
        Analysis(base + 6, "dist", ages, distribution_sql(f"SELECT e.{d.concept} AS stratum_1, year(first) - p.year_of_birth AS v FROM (SELECT {d.concept}, person_id, min({d.start}) AS first FROM {d.table} GROUP BY ALL) e JOIN person p ON p.person_id = e.person_id", "v", "stratum_1")),
        _records(months_id, d.table, stratum_1=month),
    ]
    if domain != "device":
        out += [
            _persons(base + 2, d.table, stratum_1=month, stratum_2=concept),
            Analysis(base + 3, "dist", per_person, distribution_sql(f"SELECT person_id, count(DISTINCT {d.concept}) AS v FROM {d.table} GROUP BY person_id", "v")),
        ]
    return out


def _drug_values(id_: int, column: str) -> Analysis:
    def build(cdm: Cdm) -> DataFrame:
        mean = cdm.drug_exposure.groupBy(F.col("drug_concept_id").alias("stratum_1"), "person_id").agg(F.avg(column).alias("v"))
        return distribution(mean, "v", "stratum_1")

    return Analysis(id_, "dist", build, distribution_sql(f"SELECT drug_concept_id AS stratum_1, person_id, avg({column}) AS v FROM drug_exposure GROUP BY ALL", "v", "stratum_1"))


def _present(id_: int, *tables: str) -> Analysis:
    """Persons with a record in every table."""

    def build(cdm: Cdm) -> DataFrame:
        out = cdm.table(tables[0]).select("person_id")
        for other in tables[1:]:
            out = out.join(cdm.table(other).select("person_id").distinct(), "person_id", "left_semi")
        return out.agg(F.countDistinct("person_id").alias("count_value"))

    return Analysis(id_, "person", build, f"SELECT count(DISTINCT person_id) AS count_value FROM {tables[0]} WHERE " + (" AND ".join(f"person_id IN (SELECT person_id FROM {t})" for t in tables[1:]) or "true"))


def _death_age() -> Analysis:
    def build(cdm: Cdm) -> DataFrame:
        joined = cdm.death.join(cdm.person.select("person_id", "gender_concept_id", "year_of_birth"), "person_id")
        return distribution(joined.select(F.col("gender_concept_id").alias("stratum_1"), (F.year("death_date") - F.col("year_of_birth")).cast("long").alias("v")), "v", "stratum_1")

    return Analysis(506, "dist", build, distribution_sql("SELECT p.gender_concept_id AS stratum_1, year(death_date) - p.year_of_birth AS v FROM death d JOIN person p ON p.person_id = d.person_id", "v", "stratum_1"))


def _ranges() -> Analysis:
    def build(cdm: Cdm) -> DataFrame:
        v = F.col("value_as_number")
        bucket = F.when(v < F.col("range_low"), "below").when(v > F.col("range_high"), "above").otherwise("within")
        m = cdm.measurement.where("value_as_number IS NOT NULL AND range_low IS NOT NULL AND range_high IS NOT NULL")
        return m.groupBy(F.col("measurement_concept_id").alias("stratum_1"), F.col("unit_concept_id").alias("stratum_2"), bucket.alias("stratum_3")).agg(F.count(F.lit(1)).alias("count_value"), F.countDistinct("person_id").alias("n_persons"))

    return Analysis(1818, "record", build, "SELECT measurement_concept_id AS stratum_1, unit_concept_id AS stratum_2, CASE WHEN value_as_number < range_low THEN 'below' WHEN value_as_number > range_high THEN 'above' ELSE 'within' END AS stratum_3, count(*) AS count_value, count(DISTINCT person_id) AS n_persons FROM measurement WHERE value_as_number IS NOT NULL AND range_low IS NOT NULL AND range_high IS NOT NULL GROUP BY ALL")


def catalog() -> dict[int, Analysis]:
    """Every analysis by id."""
    out = [
        _persons(1, "person"),
        _persons(2, "person", stratum_1=_col("gender_concept_id")),
        _persons(3, "person", stratum_1=_col("year_of_birth")),
        _persons(4, "person", stratum_1=_col("race_concept_id")),
        _persons(5, "person", stratum_1=_col("ethnicity_concept_id")),
        _persons(10, "person", stratum_1=_col("year_of_birth"), stratum_2=_col("gender_concept_id")),
        _persons(12, "person", stratum_1=_col("race_concept_id"), stratum_2=_col("ethnicity_concept_id")),
        *_periods(),
        *_domain(200, "visit", 220),
        _persons(221, "visit_occurrence", stratum_1=((lambda: F.year("visit_start_date").cast("long")), "year(visit_start_date)")),
        *_domain(400, "condition", 420),
        _persons(500, "death", stratum_1=_col("cause_concept_id")),
        _persons(502, "death", stratum_1=_month("death_date")),
        _records(505, "death", stratum_1=_col("death_type_concept_id")),
        _death_age(),
        *_domain(600, "procedure", 620),
        *_domain(700, "drug", 720),
        *(_drug_values(i, c) for i, c in ((715, "days_supply"), (716, "refills"), (717, "quantity"))),
        *_domain(800, "observation", 820),
        *_domain(1800, "measurement", 1820),
        _ranges(),
        _present(2000, "condition_occurrence", "drug_exposure"),
        _present(2001, "condition_occurrence", "procedure_occurrence"),
        _present(2002, "measurement", "condition_occurrence", "drug_exposure"),
        _present(2003, "visit_occurrence"),
        *_domain(2100, "device", 2102),
    ]
    return {a.id: a for a in out}
