"""Tables that other tools have computed: counts, distributions and warnings by analysis, and named result tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.gate import Policy, band

STRATA = tuple(f"stratum_{k}" for k in range(1, 6))
#: Summary columns of a distribution; the extremes are never released.
DISTRIBUTION = ("avg_value", "stdev_value", "median_value", "p10_value", "p25_value", "p75_value", "p90_value")


def analyses(tables: Mapping[str, DataFrame]) -> DataFrame:
    """The analyses that results can be of."""
    return tables["achilles_analysis"].select("analysis_id", "analysis_name", *[f"{s}_name" for s in STRATA])


def counts(tables: Mapping[str, DataFrame], ids: Sequence[int], policy: Policy = Policy(), first_stratum: Sequence[str] | None = None) -> DataFrame:
    """Counts of analyses by stratum; small ones are dropped and the others banded."""
    out = tables["achilles_results"].where(F.col("analysis_id").isin(list(ids)))
    if first_stratum is not None:
        out = out.where(F.col("stratum_1").isin(list(first_stratum)))
    return out.where(F.col("count_value") >= policy.tab).select("analysis_id", *STRATA, band(F.col("count_value"), policy.band).alias("count_value"))


def distributions(tables: Mapping[str, DataFrame], ids: Sequence[int], policy: Policy = Policy()) -> DataFrame:
    """Distributions of analyses: without extremes, and without a summary where fewer than the threshold are behind it."""
    out = tables["achilles_results_dist"].where(F.col("analysis_id").isin(list(ids)) & (F.col("count_value") >= policy.tab))
    enough = F.col("count_value") >= policy.dist
    return out.select("analysis_id", *STRATA, band(F.col("count_value"), policy.band).alias("count_value"), *[F.when(enough, F.col(c)).alias(c) for c in DISTRIBUTION])


def warnings(tables: Mapping[str, DataFrame], ids: Sequence[int] | None = None) -> DataFrame:
    """Data-quality warnings, without the counts of their records."""
    out = tables["achilles_heel_results"]
    if ids is not None:
        out = out.where(F.col("analysis_id").isin(list(ids)))
    return out.select("analysis_id", "achilles_heel_warning", "rule_id")


@dataclass(frozen=True)
class Contract:
    """What may be released of a result table: public columns; those that count persons (rows below the threshold go) and records."""

    tool: str
    public: tuple[str, ...]
    persons: tuple[str, ...] = ()
    records: tuple[str, ...] = ()


#: Contracts by table.
CONTRACTS: dict[str, Contract] = {
    "dqdashboard_results": Contract("DataQualityDashboard", ("check_name", "cdm_table_name", "cdm_field_name", "category", "subcategory", "pct_violated_rows", "passed", "failed"), records=("num_violated_rows", "num_denominator_rows")),
    "cohort_count": Contract("CohortDiagnostics", ("cohort_id", "database_id"), persons=("cohort_subjects",), records=("cohort_entries",)),
    "incidence_rate": Contract("CohortDiagnostics", ("cohort_id", "gender", "age_group", "calendar_year", "database_id", "person_years", "incidence_rate"), persons=("cohort_count",)),
}


def known_tables(tables: Mapping[str, DataFrame]) -> list[tuple[str, str]]:
    """(tool, table) of the result tables that there are."""
    return sorted((CONTRACTS[t].tool, t) for t in tables if t in CONTRACTS)


def contract(table: str) -> Contract:
    """A table's contract; without one nothing is released."""
    if table not in CONTRACTS:
        raise ValueError(f"{table} is no reviewed result table")
    return CONTRACTS[table]


def tool_results(tables: Mapping[str, DataFrame], table: str, policy: Policy = Policy(), **equal) -> DataFrame:
    """Public columns of a result table where columns have given values; rows of few persons go, counts are banded.

    Rates of rows whose banded count of persons is 0 are null.
    """
    c = contract(table)
    out = tables[table]
    for column, value in equal.items():
        if column not in c.public:
            raise ValueError(f"{column} is not public")
        out = out.where(F.col(column) == value)
    for p in c.persons:
        out = out.where(F.col(p) >= policy.tab)
    if c.persons:
        empty = band(F.least(*map(F.col, c.persons)) if len(c.persons) > 1 else F.col(c.persons[0]), policy.band) <= 0
        out = out.withColumns({r: F.when(~empty, F.col(r)) for r in c.public if r.endswith(("_rate", "_years"))})
    return out.select(*c.public, *[band(F.col(x), policy.band).alias(x) for x in (*c.persons, *c.records)])


def summary(tables: Mapping[str, DataFrame]) -> list[dict]:
    """Tool, table and public columns of each result table that there is."""
    return [{"tool": tool, "table": t, "columns": [*CONTRACTS[t].public, *CONTRACTS[t].persons, *CONTRACTS[t].records]} for tool, t in known_tables(tables)]
