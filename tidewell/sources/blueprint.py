"""What is known of a clinical database from its tables' schemas: roles of columns, dates, keys, links and version."""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame

#: Tables of the vocabulary and of metadata; all others are clinical.
VOCABULARY_TABLES = frozenset({"concept", "concept_ancestor", "concept_class", "concept_relationship", "concept_synonym", "domain", "drug_strength", "relationship", "vocabulary"})
METADATA_TABLES = frozenset({"cdm_source", "cohort", "cohort_definition", "metadata"})
#: Columns that rows never leave with.
BIRTH_PARTS = frozenset({"birth_datetime", "day_of_birth", "month_of_birth", "year_of_birth"})
FREE_TEXT = frozenset({"note_text", "note_title", "lexical_variant", "snippet", "stop_reason", "sig", "value_as_string"})
LOCAL_IDS = frozenset({"care_site_id", "location_id", "provider_id"})
#: Concept columns of tables whose name does not give them.
DOMAIN_CONCEPTS = {"person": "gender_concept_id", "death": "cause_concept_id"}
_DATES = ("date", "timestamp", "timestamp_ntz")


@dataclass(frozen=True)
class ColumnInfo:
    """A column: role is domain_concept, type_concept, source_concept, attribute_concept or non_concept."""

    name: str
    type: str
    role: str
    is_date: bool
    sensitive: bool


@dataclass(frozen=True)
class TableInfo:
    """A table; what it lacks is None."""

    name: str
    category: str
    columns: tuple[ColumnInfo, ...]
    has_person: bool
    concept_column: str | None
    date_column: str | None
    interval: tuple[str, str] | None
    key: str | None

    def column(self, name: str) -> ColumnInfo | None:
        """A column by name."""
        return next((c for c in self.columns if c.name == name), None)


def concept_column(table: str, names: list[str]) -> str | None:
    """The column of a table's own concepts."""
    if table in DOMAIN_CONCEPTS:
        found = DOMAIN_CONCEPTS[table]
        return found if found in names else None
    parts = table.split("_")
    for prefix in (table, "_".join(parts[:-1]), parts[0]):
        if prefix and f"{prefix}_concept_id" in names:
            return f"{prefix}_concept_id"
    return None


def role_of(name: str, domain_column: str | None) -> str:
    """The role of a column, by its name."""
    if name == domain_column:
        return "domain_concept"
    if name.endswith("_source_concept_id"):
        return "source_concept"
    if name.endswith("_type_concept_id"):
        return "type_concept"
    return "attribute_concept" if name.endswith("_concept_id") else "non_concept"


def date_column(columns: Mapping[str, str]) -> str | None:
    """The event date: the first start date, else the first date that ends nothing, else the first date."""
    dates = [c for c, t in columns.items() if t in _DATES and c.endswith(("_date", "_datetime"))]
    plain = [c for c in dates if c.endswith("_date")] or dates
    for good in (lambda c: "_start_date" in c, lambda c: "_end_date" not in c, lambda c: True):
        if found := next((c for c in plain if good(c)), None):
            return found
    return None


def describe(name: str, df: DataFrame) -> TableInfo:
    """A table by its schema."""
    types = dict(df.dtypes)
    own = concept_column(name, list(types))
    start = date_column(types)
    end = start.replace("_start_date", "_end_date") if start and "_start_date" in start else None
    key = "person_id" if name in ("person", "death") else f"{name}_id"
    columns = tuple(ColumnInfo(c, t, role_of(c, own), t in _DATES, c.endswith("_source_value") or c in FREE_TEXT or c in LOCAL_IDS or c in BIRTH_PARTS) for c, t in types.items())
    category = "vocabulary" if name in VOCABULARY_TABLES else "metadata" if name in METADATA_TABLES else "clinical"
    return TableInfo(name, category, columns, "person_id" in types, own, start, (start, end) if start and end in types else None, key if key in types else None)


class Blueprint:
    """The tables of a database, and the ways from each to its person."""

    def __init__(self, tables: Mapping[str, DataFrame]):
        self.tables = {name: describe(name, df) for name, df in tables.items()}
        keys = {info.key: name for name, info in self.tables.items() if info.key and info.key != "person_id"}
        if "person" in self.tables:
            keys["person_id"] = "person"
        #: (table, column, table that the column names)
        self.links = [(name, c.name, keys[c.name]) for name, info in self.tables.items() for c in info.columns if c.name in keys and keys[c.name] != name]

    def __getitem__(self, name: str) -> TableInfo:
        return self.tables[name]

    def __contains__(self, name: str) -> bool:
        return name in self.tables

    def path_to_person(self, name: str) -> list[tuple[str, str, str]] | None:
        """The fewest links from a table to one that has person_id; None where there are none."""
        ways: dict[str, list[tuple[str, str, str]]] = {name: []}
        open_ = deque([name])
        while open_:
            at = open_.popleft()
            if self.tables[at].has_person:
                return ways[at]
            for a, column, b in self.links:
                for here, there in ((a, b), (b, a)):
                    if here == at and there not in ways and self.tables[there].category == "clinical":
                        ways[there] = [*ways[at], (here, column, there)]
                        open_.append(there)
        return None

    def with_person(self, tables: Mapping[str, DataFrame], name: str) -> DataFrame:
        """A table with person_id, joined along its path."""
        path = self.path_to_person(name)
        if path is None:
            raise ValueError(f"no way from {name} to a person")
        out = tables[name]
        for k, (_, column, there) in enumerate(path):
            last = k == len(path) - 1
            other = tables[there]
            names = [column, *(["person_id"] if last and column != "person_id" else []), *([] if last else [path[k + 1][1]])]
            out = out.join(other.select(*dict.fromkeys(names)).distinct(), column)
        return out

    def version(self, tables: Mapping[str, DataFrame]) -> str | None:
        """The model's version: as cdm_source has it, else by what only one version has."""
        if "cdm_source" in tables and (row := tables["cdm_source"].select("cdm_version").where("cdm_version is not null").first()):
            if found := re.search(r"(\d+)\.(\d+)", row["cdm_version"]):
                return f"{found[1]}.{found[2]}"
        new = sum([t in self.tables for t in ("episode", "episode_event")]) + bool("procedure_occurrence" in self.tables and self.tables["procedure_occurrence"].column("procedure_end_date"))
        return "5.4" if new else "5.3" if "person" in self.tables else None

    def visible(self, name: str) -> list[str]:
        """Columns that rows of a table may leave with."""
        return [c.name for c in self.tables[name].columns if not c.sensitive]

    def filterable(self, name: str) -> list[str]:
        """Columns that may be tested: all but identifiers and sensitive ones."""
        return [c.name for c in self.tables[name].columns if not c.sensitive and not (c.name.endswith("_id") and c.role == "non_concept")]
