"""Person-centred clinical views over the supplied star-schema tables.

Every view is one SELECT over the tables before it, in SQL that Spark and
DuckDB both read; only day arithmetic differs.  Spark reads a view lazily as a
DataFrame; :func:`with_views` gives the same views as common table expressions.

The eras have about as many groups as their table has rows.  Its rows are dealt
out by group before Spark sums them, over more tasks the more rows there are.
"""

from __future__ import annotations

import functools
import re

from pyspark.sql import DataFrame, SparkSession

BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")

#: Rows that one task sums into eras, about: what its hash tables hold does not grow with the input.
TASK_ROWS = 250_000
#: Views of eras: the view that they sum up, its concept column, and the supplied table that has at least its rows.
ERAS = {"condition_era": ("condition_occurrence", "condition_concept_id", "orders"), "drug_era": ("drug_exposure", "drug_concept_id", "lineitem")}

# Concept ids of the views by domain: first id, number of ids, domain, label.
CONCEPT_RANGES = (
    (2000, 19, "Condition", "condition"),
    (2100, 4, "Condition", "condition group"),
    (3000, 5, "Measurement", "measurement"),
    (4000, 7, "Observation", "observation"),
    (5000, 9, "Procedure", "procedure"),
    (6000, 5, "Device", "device"),
    (7000, 19, "Condition", "source condition"),
    (8507, 1, "Gender", "male"),
    (8532, 1, "Gender", "female"),
    (9000, 25, "Race", "race"),
    (9100, 3, "Ethnicity", "ethnicity"),
    (9201, 5, "Visit", "visit"),
    (9300, 4, "Route", "route"),
    (9400, 2, "Unit", "unit"),
    (9500, 4, "Payer", "plan"),
    (9600, 5, "Place", "place of service"),
    (9700, 8, "Provider", "specialty"),
    (32817, 2, "Type Concept", "record type"),
)


def _concepts() -> list[tuple[int, str, str, str]]:
    out = [(0, "No matching concept", "Metadata", "S")]
    for first, n, domain, label in CONCEPT_RANGES:
        for k in range(n):
            out.append((first + k, label if n == 1 else f"{label} {k}", domain, "" if label.startswith("source") else "S"))
    return out


def _values(rows: list[tuple]) -> str:
    cell = lambda v: f"'{v}'" if isinstance(v, str) else f"CAST({v} AS BIGINT)"
    return ", ".join("(" + ", ".join(map(cell, r)) + ")" for r in rows)


def views(dialect: str) -> dict[str, str]:
    """The SELECT of each view; dialect is spark or duckdb."""
    add = (lambda d, n: f"date_add({d}, CAST({n} AS INT))") if dialect == "spark" else (lambda d, n: f"({d} + CAST({n} AS INTEGER))")
    day = lambda c: f"CAST({c} AS DATE)"
    ancestors = [(i, i, 0, 0) for i in range(2000, 2019)] + [(2100 + i % 4, i, 1, 1) for i in range(2000, 2019)] + [(i, i, 0, 0) for i in range(2100, 2104)]
    relations = [(7000 + k, 2000 + k, "Maps to", "") for k in range(19)] + [(2000 + k, 2100 + k % 4, "Is a", "D" if k == 18 else "") for k in range(19)]
    synonyms = [(2000 + k, f"cond {k}") for k in range(19)]
    return {
        "person": "SELECT c_custkey AS person_id, CASE WHEN c_custkey % 2 = 0 THEN 8532 ELSE 8507 END AS gender_concept_id, CAST(1920 + (c_custkey * 7) % 70 AS BIGINT) AS year_of_birth, CAST(1 + c_custkey % 12 AS BIGINT) AS month_of_birth, CASE WHEN c_custkey % 11 = 0 THEN 0 ELSE 9000 + c_nationkey END AS race_concept_id, CASE WHEN c_custkey % 2 = 1 THEN NULL ELSE 9100 + c_custkey % 3 END AS ethnicity_concept_id FROM customer",
        "observation_period": f"""SELECT o_custkey * 2 AS observation_period_id, o_custkey AS person_id, min({day('o_orderdate')}) AS observation_period_start_date, {add(f"max({day('o_orderdate')})", 30)} AS observation_period_end_date FROM orders GROUP BY o_custkey
UNION ALL SELECT o_custkey * 2 + 1, o_custkey, {add(f"max({day('o_orderdate')})", 200)}, {add(f"max({day('o_orderdate')})", 400)} FROM orders WHERE o_custkey % 5 = 0 GROUP BY o_custkey""",
        "visit_occurrence": f"SELECT o_orderkey AS visit_occurrence_id, o_custkey AS person_id, CAST(9200 + CAST(substr(o_orderpriority, 1, 1) AS INT) AS BIGINT) AS visit_concept_id, {day('o_orderdate')} AS visit_start_date, {add(day('o_orderdate'), 'o_orderkey % 10')} AS visit_end_date, o_orderkey % 100 AS provider_id, o_orderkey % 25 AS care_site_id, 32817 + o_orderkey % 2 AS visit_type_concept_id FROM orders",
        "condition_occurrence": f"SELECT o_orderkey AS condition_occurrence_id, o_custkey AS person_id, CASE WHEN o_orderkey % 50 = 0 THEN 0 ELSE 2000 + o_custkey % 17 + o_orderkey % 3 END AS condition_concept_id, {day('o_orderdate')} AS condition_start_date, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE {add(day('o_orderdate'), '14 + o_orderkey % 5')} END AS condition_end_date, 32817 + o_orderkey % 2 AS condition_type_concept_id, o_orderkey % 100 AS provider_id, o_orderkey AS visit_occurrence_id FROM orders",
        "drug_exposure": f"SELECT l_orderkey * 10 + l_linenumber AS drug_exposure_id, o_custkey AS person_id, CASE WHEN l_partkey % 97 = 0 THEN 0 ELSE 1000000 + l_partkey % 200 END AS drug_concept_id, {day('l_shipdate')} AS drug_exposure_start_date, {add(day('l_shipdate'), 'l_quantity')} AS drug_exposure_end_date, l_quantity AS quantity, CAST(l_quantity AS BIGINT) % 30 AS days_supply, CAST(l_linenumber AS BIGINT) AS refills, CAST(9300 + l_linenumber % 4 AS BIGINT) AS route_concept_id, 32817 + l_orderkey % 2 AS drug_type_concept_id FROM lineitem JOIN orders ON l_orderkey = o_orderkey",
        "measurement": f"SELECT event_id AS measurement_id, user_id AS person_id, CAST(3000 + length(event_type) % 5 AS BIGINT) AS measurement_concept_id, {day('ts')} AS measurement_date, CASE WHEN event_id % 13 = 0 THEN NULL ELSE value END AS value_as_number, 9400 + event_id % 2 AS unit_concept_id, CAST(10 AS DOUBLE) AS range_low, CAST(60 AS DOUBLE) AS range_high, 32817 + event_id % 2 AS measurement_type_concept_id FROM events",
        "observation": f"SELECT event_id AS observation_id, user_id AS person_id, 4000 + event_id % 7 AS observation_concept_id, {day('ts')} AS observation_date FROM events WHERE event_id % 2 = 0",
        "procedure_occurrence": f"SELECT o_orderkey AS procedure_occurrence_id, o_custkey AS person_id, 5000 + o_custkey % 9 AS procedure_concept_id, {add(day('o_orderdate'), 1)} AS procedure_date, o_orderkey AS visit_occurrence_id FROM orders WHERE o_orderkey % 4 = 0",
        "device_exposure": f"SELECT o_orderkey AS device_exposure_id, o_custkey AS person_id, 6000 + o_custkey % 5 AS device_concept_id, {day('o_orderdate')} AS device_exposure_start_date FROM orders WHERE o_orderkey % 6 = 0",
        "death": f"SELECT o_custkey AS person_id, {add(f"max({day('o_orderdate')})", 10)} AS death_date, 2000 + o_custkey % 5 AS cause_concept_id, 32817 + o_custkey % 2 AS death_type_concept_id FROM orders WHERE o_custkey % 37 = 0 GROUP BY o_custkey",
        "condition_era": "SELECT person_id, condition_concept_id, min(condition_start_date) AS condition_era_start_date, max(coalesce(condition_end_date, condition_start_date)) AS condition_era_end_date, count(*) AS condition_occurrence_count FROM condition_occurrence GROUP BY person_id, condition_concept_id",
        "drug_era": "SELECT person_id, drug_concept_id, min(drug_exposure_start_date) AS drug_era_start_date, max(drug_exposure_end_date) AS drug_era_end_date, count(*) AS drug_exposure_count FROM drug_exposure GROUP BY person_id, drug_concept_id",
        "cost": "SELECT o_orderkey * 10 + 1 AS cost_event_id, o_totalprice AS total_paid, o_totalprice * 0.1 AS paid_by_patient FROM orders WHERE o_orderkey % 2 = 0",
        "payer_plan_period": f"SELECT c_custkey AS payer_plan_period_id, c_custkey AS person_id, 9500 + c_custkey % 4 AS plan_concept_id, {add('DATE ' + repr('2000-01-01'), 'c_custkey % 1000')} AS payer_plan_period_start_date, {add('DATE ' + repr('2000-01-01'), 'c_custkey % 1000 + 365 * (c_custkey % 5)')} AS payer_plan_period_end_date FROM customer",
        "care_site": "SELECT CAST(n_nationkey AS BIGINT) AS care_site_id, CAST(9600 + n_regionkey AS BIGINT) AS place_of_service_concept_id FROM nation",
        "provider": "SELECT s_suppkey AS provider_id, 9700 + s_suppkey % 8 AS specialty_concept_id FROM supplier",
        "concept": f"SELECT CAST(concept_id AS BIGINT) AS concept_id, concept_name, domain_id, CASE WHEN standard_concept = '' THEN 'Source' ELSE 'Base' END AS vocabulary_id, standard_concept FROM (VALUES {_values(_concepts())}) AS v(concept_id, concept_name, domain_id, standard_concept) UNION ALL SELECT 1000000 + p_partkey, p_name, 'Drug', 'Part', 'S' FROM part WHERE p_partkey < 200",
        "concept_ancestor": f"SELECT ancestor_concept_id, descendant_concept_id, min_levels FROM (VALUES {_values(ancestors)}) AS v(ancestor_concept_id, descendant_concept_id, min_levels, max_levels)",
        "concept_relationship": f"SELECT concept_id_1, concept_id_2, relationship_id, CASE WHEN invalid = '' THEN NULL ELSE invalid END AS invalid_reason FROM (VALUES {_values(relations)}) AS v(concept_id_1, concept_id_2, relationship_id, invalid)",
        "concept_synonym": f"SELECT concept_id, concept_synonym_name FROM (VALUES {_values(synonyms)}) AS v(concept_id, concept_synonym_name)",
        "cohort": f"""SELECT CAST(1 AS BIGINT) AS cohort_definition_id, person_id AS subject_id, condition_start_date AS cohort_start_date, {add('condition_start_date', 90)} AS cohort_end_date FROM condition_occurrence WHERE condition_concept_id IN (2001, 2002, 2003)
UNION ALL SELECT CAST(2 AS BIGINT), person_id, procedure_date, {add('procedure_date', 180)} FROM procedure_occurrence WHERE procedure_concept_id IN (5001, 5002, 5003)
UNION ALL SELECT CAST(3 AS BIGINT), person_id, condition_start_date, {add('condition_start_date', 60)} FROM condition_occurrence WHERE condition_concept_id BETWEEN 2005 AND 2012""",
    }


@functools.lru_cache(maxsize=2)
def _order(dialect: str) -> tuple[dict[str, str], dict[str, list[str]]]:
    texts = views(dialect)
    needs = {name: [n for n in texts if n != name and re.search(rf"\b(?:FROM|JOIN) {n}\b", text)] for name, text in texts.items()}
    return texts, needs


def with_views(sql: str) -> str:
    """DuckDB SQL with the views that it reads (and those they read) as common table expressions."""
    texts, needs = _order("duckdb")
    wanted: list[str] = []

    def want(name: str) -> None:
        if name not in wanted:
            for n in needs[name]:
                want(n)
            wanted.append(name)

    for name in texts:
        if re.search(rf"\b{name}\b", sql):
            want(name)
    listed = ", ".join(f"{n} AS ({texts[n]})" for n in wanted)
    head = re.match(r"\s*WITH\s+(RECURSIVE\s+)?", sql)
    if head:
        return f"WITH {head[1] or ''}{listed}, {sql[head.end():]}" if listed else sql
    return f"WITH {listed} {sql}" if listed else sql


class Cdm:
    """Tables by name: lazily built DataFrames of the views over a folder of Parquet tables."""

    def __init__(self, spark: SparkSession, sf_dir: str, tables: dict[str, DataFrame] | None = None):
        self.spark, self.sf_dir = spark, sf_dir.rstrip("/")
        self._tables: dict[str, DataFrame] = dict(tables or {})
        self._given = frozenset(self._tables)

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.table(name)

    def table(self, name: str) -> DataFrame:
        """A view, a supplied table, or a table given at construction."""
        if name not in self._tables:
            texts, needs = _order("spark")
            if name in texts:
                text = texts[name]
                used = {n: self.table(n) for n in (*BASE, *texts) if n != name and re.search(rf"\b(?:FROM|JOIN) {n}\b", text)}
                if name in ERAS:
                    used = {n: self._dealt(df, *ERAS[name]) for n, df in used.items()}
                for n in used:
                    text = re.sub(rf"\b(FROM|JOIN) {n}\b", rf"\1 {{{n}}}", text)
                self._tables[name] = self.spark.sql(text, **used)
            else:
                self._tables[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return self._tables[name]

    def _dealt(self, df: DataFrame, name: str, concept: str, base: str) -> DataFrame:
        """df dealt out by person and concept: a task for each TASK_ROWS rows, and for each core.

        The rows are counted in the supplied table (Spark takes that from the
        files' footers).  A table given at construction would have to be
        computed for that; it goes to spark.sql.shuffle.partitions tasks.
        """
        if self._given & {name, base}:
            tasks = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        else:
            tasks = max(self.spark.sparkContext.defaultParallelism, self.table(base).count() // TASK_ROWS + 1)
        return df.repartition(tasks, "person_id", concept)
