"""The catalog of aggregate templates: each a small DataFrame plan over the clinical views, with its SQL twin.

Templates come in families (records by concept, by sex, by year, by age, by an
attribute, statistics of a value, ...).  A family builds both the DataFrame and
the SQL from one :class:`Template`.  Plans keep no limit: top-n is a matter of
release (:func:`top_n`), after the gate.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import age_ladder, age_ladder_sql, day_diff, persons, records
from ..sources.cdm import ERAS, Cdm

#: Concepts that the parameterised templates are registered with.
DEFAULT = {"condition": 2003, "drug": 1000003, "measurement": 3001, "observation": 4001, "procedure": 5001, "device": 6001}


@dataclass(frozen=True)
class Domain:
    """How an event table names its columns."""

    table: str
    concept: str
    start: str
    end: str | None = None
    type: str | None = None


DOMAINS = {
    "condition": Domain("condition_occurrence", "condition_concept_id", "condition_start_date", "condition_end_date", "condition_type_concept_id"),
    "drug": Domain("drug_exposure", "drug_concept_id", "drug_exposure_start_date", "drug_exposure_end_date", "drug_type_concept_id"),
    "measurement": Domain("measurement", "measurement_concept_id", "measurement_date", None, "measurement_type_concept_id"),
    "observation": Domain("observation", "observation_concept_id", "observation_date"),
    "procedure": Domain("procedure_occurrence", "procedure_concept_id", "procedure_date"),
    "device": Domain("device_exposure", "device_concept_id", "device_exposure_start_date"),
    "visit": Domain("visit_occurrence", "visit_concept_id", "visit_start_date", "visit_end_date", "visit_type_concept_id"),
    "condition_era": Domain("condition_era", "condition_concept_id", "condition_era_start_date", "condition_era_end_date"),
    "drug_era": Domain("drug_era", "drug_concept_id", "drug_era_start_date", "drug_era_end_date"),
    "death": Domain("death", "cause_concept_id", "death_date", None, "death_type_concept_id"),
}
COVERED = ("condition", "drug", "measurement", "observation", "procedure", "visit")


@dataclass(frozen=True)
class Template:
    """A catalog entry: id, whether its raw result may be released, its plan and its SQL."""

    id: str
    safety: str
    build: Callable[[Cdm], DataFrame]
    sql: str

    @property
    def name(self) -> str:
        return self.id.replace(".", "_")


def named(df: DataFrame, cdm: Cdm, column: str, name: str, how: str = "inner") -> DataFrame:
    """df with the name of a concept column, joined from the vocabulary."""
    c = cdm.concept.select(F.col("concept_id").alias("_cid"), F.col("concept_name").alias(name))
    return df.join(c, F.col(column) == F.col("_cid"), how).drop("_cid")


def _persons(table: str, concept: str) -> Column:
    """Distinct persons of groups that each hold one concept, never null.

    Eras count them as distinct pairs, which is the same number: Spark then
    leaves the DISTINCT out where an era is known to be a person and concept's
    only one, and so two hash tables as large as that of the eras.
    """
    return F.countDistinct(concept, "person_id").alias("n_persons") if table in ERAS else persons()


def top_n(df: DataFrame, n: int, band: int = 5, by: str = "n_persons", key: str = "concept_id") -> DataFrame:
    """The n best supported rows; support is banded first, so order within a band tells nothing."""
    return df.orderBy(F.desc(F.floor(F.col(by) / band) * band), key).limit(n)


def _by_concept(id_: str, domain: str, safety: str = "SAFE_AGGREGATE", name: str | None = None) -> Template:
    d = DOMAINS[domain]

    def build(cdm: Cdm) -> DataFrame:
        ev = cdm.table(d.table).where(F.col(d.concept) != 0)
        return named(ev.groupBy(F.col(d.concept).alias("concept_id")).agg(_persons(d.table, d.concept), records()), cdm, "concept_id", "concept_name")

    return Template(id_, safety, build, f"SELECT e.{d.concept} AS concept_id, c.concept_name, count(DISTINCT person_id) AS n_persons, count(*) AS n_records FROM {d.table} e JOIN concept c ON c.concept_id = e.{d.concept} WHERE e.{d.concept} <> 0 GROUP BY ALL")


def _by_sex(id_: str, domain: str) -> Template:
    d, concept = DOMAINS[domain], DEFAULT[domain.split("_")[0]]

    def build(cdm: Cdm) -> DataFrame:
        ev = cdm.table(d.table).where(F.col(d.concept) == concept).select("person_id", d.concept)
        out = ev.join(cdm.person.select("person_id", "gender_concept_id"), "person_id").groupBy(d.concept, "gender_concept_id").agg(persons())
        return named(named(out, cdm, d.concept, "concept_name"), cdm, "gender_concept_id", "gender_name").drop("gender_concept_id")

    return Template(id_, "SAFE_AGGREGATE", build, f"SELECT e.{d.concept}, c.concept_name, g.concept_name AS gender_name, count(DISTINCT e.person_id) AS n_persons FROM {d.table} e JOIN person p ON p.person_id = e.person_id JOIN concept c ON c.concept_id = e.{d.concept} JOIN concept g ON g.concept_id = p.gender_concept_id WHERE e.{d.concept} = {concept} GROUP BY ALL")


def _by_year(id_: str, domain: str, year: str, concept: int = 0) -> Template:
    d = DOMAINS[domain]

    def build(cdm: Cdm) -> DataFrame:
        ev = cdm.table(d.table).where((F.col(d.concept) != 0) if concept == 0 else (F.col(d.concept) == concept))
        out = ev.groupBy(d.concept, F.year(d.start).cast("long").alias(year)).agg(persons(), records())
        return named(out, cdm, d.concept, "concept_name")

    return Template(id_, "SAFE_AGGREGATE", build, f"SELECT e.{d.concept}, c.concept_name, year({d.start}) AS {year}, count(DISTINCT person_id) AS n_persons, count(*) AS n_records FROM {d.table} e JOIN concept c ON c.concept_id = e.{d.concept} WHERE e.{d.concept} <> 0 AND ({concept} = 0 OR e.{d.concept} = {concept}) GROUP BY ALL")


def _by_age(id_: str, domain: str, last: int = 80) -> Template:
    d, concept = DOMAINS[domain], DEFAULT.get(domain, 0)

    def build(cdm: Cdm) -> DataFrame:
        ev = cdm.table(d.table).select("person_id", d.concept, d.start)
        ev = ev.where(F.col(d.concept) == concept) if concept else ev.where(F.col(d.concept) != 0)
        age = F.year(d.start) - F.col("year_of_birth")
        out = ev.join(cdm.person.select("person_id", "year_of_birth"), "person_id").groupBy(d.concept, age_ladder(age, last).alias("age_group")).agg(persons())
        return named(out, cdm, d.concept, "concept_name")

    where = f"e.{d.concept} = {concept}" if concept else f"e.{d.concept} <> 0"
    return Template(id_, "SAFE_AGGREGATE", build, f"SELECT e.{d.concept}, c.concept_name, {age_ladder_sql(f'year(e.{d.start}) - p.year_of_birth', last)} AS age_group, count(DISTINCT e.person_id) AS n_persons FROM {d.table} e JOIN person p ON p.person_id = e.person_id JOIN concept c ON c.concept_id = e.{d.concept} WHERE {where} GROUP BY ALL")


def _by_attribute(id_: str, domain: str, column: str, name: str, all_concepts: bool = False) -> Template:
    d = DOMAINS[domain]
    concept = DEFAULT.get(domain, 0)

    def build(cdm: Cdm) -> DataFrame:
        ev = cdm.table(d.table) if all_concepts else cdm.table(d.table).where(F.col(d.concept) == concept)
        return named(ev.groupBy(column).agg(persons(), records()), cdm, column, name)

    where = "" if all_concepts else f"WHERE e.{d.concept} = {concept}"
    return Template(id_, "SAFE_AGGREGATE", build, f"SELECT e.{column}, c.concept_name AS {name}, count(DISTINCT e.person_id) AS n_persons, count(*) AS n_records FROM {d.table} e JOIN concept c ON c.concept_id = e.{column} {where} GROUP BY ALL")


def _stats(id_: str, domain: str, value: Callable[[], Column], value_sql: str, label: str, where: str, counted: str = "n_records") -> Template:
    d = DOMAINS[domain]

    def build(cdm: Cdm) -> DataFrame:
        ev = cdm.table(d.table).where(where).where(F.col(d.concept) != 0)
        out = ev.groupBy(d.concept).agg(_persons(d.table, d.concept), records().alias(counted), F.round(F.avg(value()), 6).alias(f"avg_{label}"), F.round(F.stddev_samp(value()), 6).alias(f"sd_{label}"))
        return named(out, cdm, d.concept, "concept_name")

    return Template(id_, "BLOCKED", build, f"SELECT e.{d.concept}, c.concept_name, count(DISTINCT person_id) AS n_persons, count(*) AS {counted}, round(avg({value_sql}), 6) AS avg_{label}, round(stddev_samp({value_sql}), 6) AS sd_{label} FROM {d.table} e JOIN concept c ON c.concept_id = e.{d.concept} WHERE {where} AND e.{d.concept} <> 0 GROUP BY ALL")


def _days(a: str, b: str) -> tuple[Callable[[], Column], str]:
    """Days from b to a."""
    return (lambda: day_diff(F.col(a), F.col(b))), f"date_diff('day', {b}, {a})"


def _pairs(id_: str, left: str, right: str, prefix: str) -> Template:
    """Persons with the index concept and another one."""
    a, b, concept = DOMAINS[left], DOMAINS[right], DEFAULT[left]

    def build(cdm: Cdm) -> DataFrame:
        index = cdm.table(a.table).where(F.col(a.concept) == concept).select("person_id").distinct()
        other = cdm.table(b.table).where((F.col(b.concept) != 0) & (F.lit(left != right) | (F.col(b.concept) != concept)))
        # The index side is one row a person, so the join does not fan out.
        out = other.join(index, "person_id", "left_semi").groupBy(F.col(b.concept).alias(f"{prefix}_concept_id")).agg(persons())
        return named(out, cdm, f"{prefix}_concept_id", f"{prefix}_name")

    same = f"AND y.{b.concept} <> {concept}" if left == right else ""
    return Template(id_, "SAFE_AGGREGATE", build, f"SELECT y.{b.concept} AS {prefix}_concept_id, c.concept_name AS {prefix}_name, count(DISTINCT y.person_id) AS n_persons FROM {a.table} x JOIN {b.table} y ON y.person_id = x.person_id JOIN concept c ON c.concept_id = y.{b.concept} WHERE x.{a.concept} = {concept} {same} AND y.{b.concept} <> 0 GROUP BY ALL")


def _drug_overlap() -> Template:
    def build(cdm: Cdm) -> DataFrame:
        co = cdm.condition_occurrence.where(F.col("condition_concept_id") == DEFAULT["condition"]).select("person_id", "condition_concept_id").distinct()
        de = cdm.drug_exposure.where("drug_concept_id <> 0").select("person_id", "drug_concept_id").distinct()
        out = co.join(de, "person_id").groupBy("condition_concept_id", "drug_concept_id").agg(F.count(F.lit(1)).alias("n_persons"))
        return named(named(out, cdm, "condition_concept_id", "condition_name"), cdm, "drug_concept_id", "drug_name")

    return Template("condition.drug_overlap", "SAFE_AGGREGATE", build, f"SELECT x.condition_concept_id, y.drug_concept_id, cc.concept_name AS condition_name, dc.concept_name AS drug_name, count(DISTINCT x.person_id) AS n_persons FROM condition_occurrence x JOIN drug_exposure y ON y.person_id = x.person_id JOIN concept cc ON cc.concept_id = x.condition_concept_id JOIN concept dc ON dc.concept_id = y.drug_concept_id WHERE x.condition_concept_id = {DEFAULT['condition']} AND y.drug_concept_id <> 0 GROUP BY ALL")


def _mortality() -> Template:
    def build(cdm: Cdm) -> DataFrame:
        ev = cdm.condition_occurrence.where("condition_concept_id <> 0").select("person_id", "condition_concept_id").distinct()
        dead = cdm.death.select("person_id", F.lit(1).alias("dead")).distinct()
        out = ev.join(dead, "person_id", "left").groupBy(F.col("condition_concept_id").alias("concept_id")).agg(F.count(F.lit(1)).alias("n_total"), F.count("dead").alias("n_deaths"))
        return named(out, cdm, "concept_id", "concept_name")

    return Template("condition.mortality_rate", "SAFE_AGGREGATE", build, "SELECT e.condition_concept_id AS concept_id, c.concept_name, count(DISTINCT e.person_id) AS n_total, count(DISTINCT d.person_id) AS n_deaths FROM condition_occurrence e JOIN concept c ON c.concept_id = e.condition_concept_id LEFT JOIN death d ON d.person_id = e.person_id WHERE e.condition_concept_id <> 0 GROUP BY ALL")


def _joined(id_: str, build: Callable[[Cdm], DataFrame], sql: str, safety: str = "SAFE_AGGREGATE") -> Template:
    return Template(id_, safety, build, sql)


def _season(c: str) -> Column:
    m = F.month(c)
    return F.when(m.isin(12, 1, 2), "Winter").when(m.isin(3, 4, 5), "Spring").when(m.isin(6, 7, 8), "Summer").otherwise("Autumn")


def _person_by(id_: str, column: str, name: str) -> Template:
    return Template(id_, "SAFE_AGGREGATE", lambda cdm: named(cdm.person.groupBy(column).agg(persons()), cdm, column, name), f"SELECT p.{column}, c.concept_name AS {name}, count(DISTINCT p.person_id) AS n_persons FROM person p JOIN concept c ON c.concept_id = p.{column} GROUP BY ALL")


def _load(id_: str, table: str, concepts: dict[str, str]) -> Template:
    """Rows with the names of their concept columns."""

    def build(cdm: Cdm) -> DataFrame:
        out = cdm.table(table)
        for column, name in concepts.items():
            out = named(out, cdm, column, name, "left")
        return out.select(*[F.date_format(c, "yyyy-MM-dd").alias(c) if t == "date" else F.col(c) for c, t in out.dtypes])

    joins = " ".join(f"LEFT JOIN concept c{k} ON c{k}.concept_id = t.{column}" for k, column in enumerate(concepts))
    dates = ", ".join(f"strftime({c}, '%Y-%m-%d') AS {c}" for c in {"death": ["death_date"]}.get(table) or [d for k in DOMAINS.values() if k.table == table for d in (k.start, k.end) if d])
    star = f"t.* REPLACE ({dates})" if dates else "t.*"
    return Template(id_, "BLOCKED" if table == "person" else "SAFE_ASSIGN", build, f"SELECT {star}, {', '.join(f'c{k}.concept_name AS {n}' for k, n in enumerate(concepts.values()))} FROM {table} t {joins}")


def _union(id_: str, key: str, by_year: bool) -> Template:
    def build(cdm: Cdm) -> DataFrame:
        out = None
        for domain in COVERED:
            d = DOMAINS[domain]
            groups = [F.year(d.start).cast("long").alias("record_year")] if by_year else []
            part = cdm.table(d.table).groupBy(*groups).agg(persons(), records()).withColumn(key, F.lit(domain if key == "domain" else d.table))
            out = part if out is None else out.unionByName(part)
        return out

    parts = []
    for domain in COVERED:
        d = DOMAINS[domain]
        year = f"year({d.start}) AS record_year, " if by_year else ""
        parts.append(f"SELECT '{domain if key == 'domain' else d.table}' AS {key}, {year}count(DISTINCT person_id) AS n_persons, count(*) AS n_records FROM {d.table}" + (" GROUP BY ALL" if by_year else ""))
    return Template(id_, "SAFE_AGGREGATE", build, " UNION ALL ".join(parts))


def _period_stats() -> list[Template]:
    length = lambda: day_diff(F.col("observation_period_end_date"), F.col("observation_period_start_date"))
    length_sql = "date_diff('day', observation_period_start_date, observation_period_end_date)"
    start_year = lambda: F.year("observation_period_start_date").cast("long")
    months = lambda: (F.year("observation_period_end_date") - F.year("observation_period_start_date")) * 12 + F.month("observation_period_end_date") - F.month("observation_period_start_date")
    months_sql = "(year(observation_period_end_date) - year(observation_period_start_date)) * 12 + month(observation_period_end_date) - month(observation_period_start_date)"
    return [
        Template("observation_period.coverage_by_year", "SAFE_AGGREGATE", lambda cdm: cdm.observation_period.groupBy(start_year().alias("start_year")).agg(persons(), records().alias("n_periods")), "SELECT year(observation_period_start_date) AS start_year, count(DISTINCT person_id) AS n_persons, count(*) AS n_periods FROM observation_period GROUP BY ALL"),
        Template("observation_period.length_by_gender", "BLOCKED", lambda cdm: named(cdm.observation_period.join(cdm.person.select("person_id", "gender_concept_id"), "person_id").groupBy("gender_concept_id").agg(persons(), F.round(F.avg(length()), 6).alias("avg_days")), cdm, "gender_concept_id", "gender_name").drop("gender_concept_id"), f"SELECT g.concept_name AS gender_name, count(DISTINCT o.person_id) AS n_persons, round(avg({length_sql}), 6) AS avg_days FROM observation_period o JOIN person p ON p.person_id = o.person_id JOIN concept g ON g.concept_id = p.gender_concept_id GROUP BY ALL"),
        Template("observation_period.length_months_stats", "BLOCKED", lambda cdm: cdm.observation_period.groupBy(start_year().alias("start_year")).agg(persons(), F.round(F.avg(months()), 6).alias("avg_months"), F.round(F.stddev_samp(months()), 6).alias("stddev_months")), f"SELECT year(observation_period_start_date) AS start_year, count(DISTINCT person_id) AS n_persons, round(avg({months_sql}), 6) AS avg_months, round(stddev_samp({months_sql}), 6) AS stddev_months FROM observation_period GROUP BY ALL"),
        Template("observation_period.length_stats", "BLOCKED", lambda cdm: cdm.observation_period.groupBy(start_year().alias("start_year")).agg(persons(), F.round(F.avg(length()), 6).alias("avg_days")), f"SELECT year(observation_period_start_date) AS start_year, count(DISTINCT person_id) AS n_persons, round(avg({length_sql}), 6) AS avg_days FROM observation_period GROUP BY ALL"),
        Template("observation_period.long_period_count", "SAFE_AGGREGATE", lambda cdm: cdm.observation_period.where(length() >= 365).agg(persons()), f"SELECT count(DISTINCT person_id) AS n_persons FROM observation_period WHERE {length_sql} >= 365"),
        Template("observation_period.persons_with_n_periods", "SAFE_AGGREGATE", lambda cdm: cdm.observation_period.groupBy("person_id").agg(records().alias("n_periods")).groupBy("n_periods").agg(F.count(F.lit(1)).alias("n_persons")), "SELECT n_periods, count(*) AS n_persons FROM (SELECT person_id, count(*) AS n_periods FROM observation_period GROUP BY person_id) GROUP BY n_periods"),
    ]


def _others() -> list[Template]:
    era_days, era_sql = _days("drug_era_end_date", "drug_era_start_date")
    literal = lambda y, m, d: y * 365 + m * 30 + d
    era_literal = lambda: literal(F.year("condition_era_end_date"), F.month("condition_era_end_date"), F.dayofmonth("condition_era_end_date")) - literal(F.year("condition_era_start_date"), F.month("condition_era_start_date"), F.dayofmonth("condition_era_start_date"))
    era_literal_sql = "(year(condition_era_end_date) * 365 + month(condition_era_end_date) * 30 + day(condition_era_end_date)) - (year(condition_era_start_date) * 365 + month(condition_era_start_date) * 30 + day(condition_era_start_date))"
    visit_days, visit_sql = _days("visit_end_date", "visit_start_date")
    cond_days, cond_sql = _days("condition_end_date", "condition_start_date")
    drug_days, drug_sql = _days("drug_exposure_end_date", "drug_exposure_start_date")
    ladder = lambda reference, last: age_ladder(F.lit(reference) - F.col("year_of_birth"), last)

    def cost(id_: str, value: Callable[[], Column], value_sql: str, label: str, where: str) -> Template:
        def build(cdm: Cdm) -> DataFrame:
            joined = cdm.cost.join(cdm.drug_exposure, F.col("cost_event_id") == F.col("drug_exposure_id")).where(where)
            return named(joined.groupBy("drug_concept_id").agg(persons(), records(), F.round(F.avg(value()), 4).alias(f"avg_{label}"), F.round(F.stddev_samp(value()), 4).alias(f"sd_{label}")), cdm, "drug_concept_id", "concept_name")

        return Template(id_, "BLOCKED", build, f"SELECT drug_concept_id, c.concept_name, count(DISTINCT person_id) AS n_persons, count(*) AS n_records, round(avg({value_sql}), 4) AS avg_{label}, round(stddev_samp({value_sql}), 4) AS sd_{label} FROM cost JOIN drug_exposure ON cost_event_id = drug_exposure_id JOIN concept c ON c.concept_id = drug_concept_id WHERE {where} GROUP BY ALL")

    def by_site(cdm: Cdm) -> DataFrame:
        out = cdm.visit_occurrence.join(cdm.care_site, "care_site_id").groupBy("place_of_service_concept_id").agg(persons(), records().alias("n_visits"))
        return named(out, cdm, "place_of_service_concept_id", "place_of_service_name").drop("place_of_service_concept_id")

    def by_specialty(cdm: Cdm) -> DataFrame:
        ev = cdm.condition_occurrence.where(F.col("condition_concept_id") == DEFAULT["condition"]).join(cdm.provider, "provider_id")
        return named(ev.groupBy("specialty_concept_id").agg(persons()), cdm, "specialty_concept_id", "specialty_name").drop("specialty_concept_id")

    def by_visit_type(cdm: Cdm) -> DataFrame:
        ev = cdm.condition_occurrence.where(F.col("condition_concept_id") == DEFAULT["condition"]).select("person_id", "visit_occurrence_id")
        return named(ev.join(cdm.visit_occurrence.select("visit_occurrence_id", "visit_concept_id"), "visit_occurrence_id").groupBy("visit_concept_id").agg(persons(), records()), cdm, "visit_concept_id", "visit_name")

    def season(cdm: Cdm) -> DataFrame:
        ev = cdm.condition_era.where(F.col("condition_concept_id") == DEFAULT["condition"])
        return named(ev.groupBy("condition_concept_id", _season("condition_era_start_date").alias("season")).agg(persons(), records()), cdm, "condition_concept_id", "concept_name")

    def death_by_age(cdm: Cdm) -> DataFrame:
        return cdm.death.join(cdm.person.select("person_id", "year_of_birth"), "person_id").groupBy(age_ladder(F.year("death_date") - F.col("year_of_birth"), 90).alias("age_group")).agg(persons())

    def death_by_sex(cdm: Cdm) -> DataFrame:
        return named(cdm.death.join(cdm.person.select("person_id", "gender_concept_id"), "person_id").groupBy("gender_concept_id").agg(persons()), cdm, "gender_concept_id", "gender_name").drop("gender_concept_id")

    def visit_by_sex(cdm: Cdm) -> DataFrame:
        out = cdm.visit_occurrence.join(cdm.person.select("person_id", "gender_concept_id"), "person_id").groupBy("visit_concept_id", "gender_concept_id").agg(persons(), records())
        return named(named(out, cdm, "visit_concept_id", "visit_name"), cdm, "gender_concept_id", "gender_name").drop("gender_concept_id")

    return [
        _joined("care_site.place_of_service_summary", by_site, "SELECT c.concept_name AS place_of_service_name, count(DISTINCT person_id) AS n_persons, count(*) AS n_visits FROM visit_occurrence v JOIN care_site s ON s.care_site_id = v.care_site_id JOIN concept c ON c.concept_id = s.place_of_service_concept_id GROUP BY ALL"),
        _joined("condition.prevalence_by_specialty", by_specialty, f"SELECT c.concept_name AS specialty_name, count(DISTINCT person_id) AS n_persons FROM condition_occurrence e JOIN provider p ON p.provider_id = e.provider_id JOIN concept c ON c.concept_id = p.specialty_concept_id WHERE e.condition_concept_id = {DEFAULT['condition']} GROUP BY ALL"),
        _joined("condition.prevalence_by_visit_type", by_visit_type, f"SELECT v.visit_concept_id, c.concept_name AS visit_name, count(DISTINCT e.person_id) AS n_persons, count(*) AS n_records FROM condition_occurrence e JOIN visit_occurrence v ON v.visit_occurrence_id = e.visit_occurrence_id JOIN concept c ON c.concept_id = v.visit_concept_id WHERE e.condition_concept_id = {DEFAULT['condition']} GROUP BY ALL"),
        _joined("condition_era.by_season", season, f"SELECT e.condition_concept_id, c.concept_name, CASE WHEN month(condition_era_start_date) IN (12, 1, 2) THEN 'Winter' WHEN month(condition_era_start_date) IN (3, 4, 5) THEN 'Spring' WHEN month(condition_era_start_date) IN (6, 7, 8) THEN 'Summer' ELSE 'Autumn' END AS season, count(DISTINCT person_id) AS n_persons, count(*) AS n_records FROM condition_era e JOIN concept c ON c.concept_id = e.condition_concept_id WHERE e.condition_concept_id = {DEFAULT['condition']} GROUP BY ALL"),
        _joined("condition_era.eras_per_person_stats", lambda cdm: cdm.condition_era.groupBy("person_id").agg(records().alias("k")).agg(F.count(F.lit(1)).alias("n_persons"), F.round(F.avg("k"), 6).alias("avg_eras"), F.round(F.stddev_samp("k"), 6).alias("stddev_eras")), "SELECT count(*) AS n_persons, round(avg(k), 6) AS avg_eras, round(stddev_samp(k), 6) AS stddev_eras FROM (SELECT person_id, count(*) AS k FROM condition_era GROUP BY person_id)", "BLOCKED"),
        _stats("condition_era.length_stats", "condition_era", era_literal, era_literal_sql, "days", "condition_era_end_date IS NOT NULL", "n_eras"),
        _stats("condition.duration_stats", "condition", cond_days, cond_sql, "days", "condition_end_date IS NOT NULL"),
        _stats("drug.duration_stats", "drug", drug_days, drug_sql, "days", "drug_exposure_end_date IS NOT NULL"),
        _stats("drug.days_supply_stats", "drug", lambda: F.col("days_supply"), "days_supply", "days_supply", "days_supply IS NOT NULL"),
        _stats("drug.quantity_stats", "drug", lambda: F.col("quantity"), "quantity", "quantity", "quantity IS NOT NULL"),
        _stats("drug_era.length_stats", "drug_era", era_days, era_sql, "days", "drug_era_end_date IS NOT NULL", "n_eras"),
        _stats("drug_era.exposure_count_stats", "drug_era", lambda: F.col("drug_exposure_count"), "drug_exposure_count", "exposure_count", "drug_exposure_count IS NOT NULL", "n_eras"),
        _stats("measurement.value_stats", "measurement", lambda: F.col("value_as_number"), "value_as_number", "value", "value_as_number IS NOT NULL", "n_values"),
        _stats("visit.duration_stats", "visit", visit_days, visit_sql, "days", "visit_end_date IS NOT NULL", "n_visits"),
        cost("drug_cost.cost_per_unit_stats", lambda: F.col("total_paid") / F.col("quantity"), "total_paid / quantity", "cost_per_unit", "quantity > 0 AND drug_concept_id <> 0"),
        cost("drug_cost.out_of_pocket_stats", lambda: F.col("paid_by_patient"), "paid_by_patient", "out_of_pocket", "drug_concept_id <> 0"),
        _joined("death.by_age", death_by_age, f"SELECT {age_ladder_sql('year(death_date) - year_of_birth', 90)} AS age_group, count(DISTINCT d.person_id) AS n_persons FROM death d JOIN person p ON p.person_id = d.person_id GROUP BY ALL"),
        _joined("death.by_gender", death_by_sex, "SELECT g.concept_name AS gender_name, count(DISTINCT d.person_id) AS n_persons FROM death d JOIN person p ON p.person_id = d.person_id JOIN concept g ON g.concept_id = p.gender_concept_id GROUP BY ALL"),
        _joined("death.summary", lambda cdm: named(cdm.death.groupBy("cause_concept_id").agg(persons()), cdm, "cause_concept_id", "cause_name"), "SELECT cause_concept_id, c.concept_name AS cause_name, count(DISTINCT person_id) AS n_persons FROM death JOIN concept c ON c.concept_id = cause_concept_id GROUP BY ALL"),
        _joined("drug_era.by_month", lambda cdm: named(cdm.drug_era.where("drug_concept_id <> 0").groupBy("drug_concept_id", F.month("drug_era_start_date").cast("long").alias("start_month")).agg(_persons("drug_era", "drug_concept_id"), records()), cdm, "drug_concept_id", "concept_name"), "SELECT drug_concept_id, c.concept_name, month(drug_era_start_date) AS start_month, count(DISTINCT person_id) AS n_persons, count(*) AS n_records FROM drug_era JOIN concept c ON c.concept_id = drug_concept_id WHERE drug_concept_id <> 0 GROUP BY ALL"),
        _joined("payer_plan.by_plan_concept", lambda cdm: named(cdm.payer_plan_period.groupBy("plan_concept_id").agg(persons()), cdm, "plan_concept_id", "concept_name"), "SELECT plan_concept_id, c.concept_name, count(DISTINCT person_id) AS n_persons FROM payer_plan_period JOIN concept c ON c.concept_id = plan_concept_id GROUP BY ALL"),
        _joined("payer_plan.length_distribution", lambda cdm: cdm.payer_plan_period.groupBy((F.year("payer_plan_period_end_date") - F.year("payer_plan_period_start_date")).cast("long").alias("years_covered")).agg(persons()), "SELECT year(payer_plan_period_end_date) - year(payer_plan_period_start_date) AS years_covered, count(DISTINCT person_id) AS n_persons FROM payer_plan_period GROUP BY ALL"),
        _joined("person.age_distribution_decade", lambda cdm: cdm.person.groupBy(ladder(2002, 90).alias("age_group")).agg(persons()), f"SELECT {age_ladder_sql('2002 - year_of_birth', 90)} AS age_group, count(DISTINCT person_id) AS n_persons FROM person GROUP BY ALL"),
        _joined("person.birth_month_distribution", lambda cdm: cdm.person.groupBy("month_of_birth").agg(persons()), "SELECT month_of_birth, count(DISTINCT person_id) AS n_persons FROM person GROUP BY ALL", "BLOCKED"),
        _joined("person.year_of_birth_distribution", lambda cdm: cdm.person.groupBy("year_of_birth").agg(persons()), "SELECT year_of_birth, count(DISTINCT person_id) AS n_persons FROM person GROUP BY ALL", "BLOCKED"),
        _joined("person.gender_by_age_decade", lambda cdm: named(cdm.person.groupBy("gender_concept_id", ladder(2002, 80).alias("age_group")).agg(persons()), cdm, "gender_concept_id", "gender_name").drop("gender_concept_id"), f"SELECT g.concept_name AS gender_name, {age_ladder_sql('2002 - year_of_birth', 80)} AS age_group, count(DISTINCT person_id) AS n_persons FROM person JOIN concept g ON g.concept_id = gender_concept_id GROUP BY ALL", "BLOCKED"),
        _joined("visit.type_by_gender", visit_by_sex, "SELECT v.visit_concept_id, c.concept_name AS visit_name, g.concept_name AS gender_name, count(DISTINCT v.person_id) AS n_persons, count(*) AS n_records FROM visit_occurrence v JOIN person p ON p.person_id = v.person_id JOIN concept c ON c.concept_id = v.visit_concept_id JOIN concept g ON g.concept_id = p.gender_concept_id GROUP BY ALL"),
    ]


def catalog() -> dict[str, Template]:
    """Every template by id."""
    out = [
        _pairs("condition.comorbidity", "condition", "condition", "comorbid"),
        _pairs("drug.concomitant_medications", "drug", "drug", "concomitant"),
        _drug_overlap(),
        _mortality(),
        *(_by_concept(f"{k}.prevalence_by_concept", k) for k in ("condition", "condition_era", "drug", "drug_era", "device", "measurement", "observation", "procedure")),
        _by_concept("visit.type_summary", "visit"),
        *(_by_sex(f"{k}.prevalence_by_gender", k) for k in ("condition", "drug", "measurement", "observation", "procedure")),
        _by_sex("condition_era.by_gender", "condition_era"),
        *(_by_year(f"{k}.prevalence_by_year", k, {"drug": "exposure_year"}.get(k, f"{k}_year")) for k in ("condition", "drug", "measurement", "observation", "procedure")),
        _by_year("visit.type_by_year", "visit", "visit_year"),
        *(_by_age(f"{k}.prevalence_by_age", k, 90 if k == "drug" else 80) for k in ("condition", "drug", "measurement", "procedure")),
        _by_age("visit.type_by_age", "visit", 90),
        _by_attribute("condition_occurrence.type_distribution", "condition", "condition_type_concept_id", "condition_type_name", True),
        _by_attribute("drug_exposure.type_distribution", "drug", "drug_type_concept_id", "drug_type_name", True),
        _by_attribute("drug.prevalence_by_route", "drug", "route_concept_id", "route_name"),
        _by_attribute("measurement.prevalence_by_unit", "measurement", "unit_concept_id", "unit_name"),
        _union("general.domain_coverage", "domain", False),
        _union("general.record_count_by_table", "table_name", False),
        _union("general.temporal_coverage", "domain", True),
        _person_by("person.demographic_summary", "gender_concept_id", "gender_name"),
        _person_by("person.ethnicity_distribution", "ethnicity_concept_id", "ethnicity_name"),
        _person_by("person.race_distribution", "race_concept_id", "race_name"),
        _load("condition_occurrence.load", "condition_occurrence", {"condition_concept_id": "condition_name", "condition_type_concept_id": "condition_type_name"}),
        _load("death.load", "death", {"cause_concept_id": "cause_name", "death_type_concept_id": "death_type_name"}),
        _load("drug_exposure.load", "drug_exposure", {"drug_concept_id": "drug_name", "drug_type_concept_id": "drug_type_name", "route_concept_id": "route_name"}),
        _load("measurement.load", "measurement", {"measurement_concept_id": "measurement_name", "unit_concept_id": "unit_name", "measurement_type_concept_id": "measurement_type_name"}),
        _load("observation.load", "observation", {"observation_concept_id": "observation_name"}),
        _load("person.load", "person", {"gender_concept_id": "gender_name", "race_concept_id": "race_name", "ethnicity_concept_id": "ethnicity_name"}),
        _load("procedure_occurrence.load", "procedure_occurrence", {"procedure_concept_id": "procedure_name"}),
        *_period_stats(),
        *_others(),
    ]
    return {t.id: t for t in out}
