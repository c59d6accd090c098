"""A session over one clinical database: what users call.

Frames that stay with the server are kept by name; what is released passes one
gate, which suppresses on exact counts, bands them, and leaves a line in the
audit log.  All of it is lazy but for the counts that the gate itself needs.
"""

from __future__ import annotations

import secrets
import time
from collections.abc import Mapping, Sequence
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import cohorts, concepts, features, filters, noise, profile, tokens, verbs
from .operators.gate import DisclosureError, Policy, assert_min_persons, band, gate, pooling_contract, safe_levels
from .plans import outputs, scores, standard, templates
from .plans.extract import SpecError, extract
from .plans.outputs import Plan
from .plans.registry import Entry, entries
from .sources import results, sinks
from .sources.blueprint import Blueprint
from .sources.cdm import Cdm, views

# Names of columns that count persons, and of those that count records.
PERSON_COUNTS = ("n_persons", "n_subjects", "persons", "subjects", "n_covered", "n_with_outcome", "deaths", "n_deaths", "cases")
RECORD_COUNTS = ("n_records", "n_visits", "n_events", "n_eras", "records", "entries", "events", "n_outcomes", "person_days", "n_periods")
#: Seconds that issued bin edges hold.
EDGES_HOLD = 3600


class Session:
    """A database, the policy of its releases, and what has been made of it."""

    def __init__(self, spark: SparkSession, tables: Mapping[str, DataFrame] | Cdm, policy: Policy = Policy(), secret: bytes | None = None, grids: Mapping[str, Sequence[float]] | None = None, definitions: DataFrame | None = None, epsilon: float = 0.1):
        self.spark, self.policy, self.epsilon = spark, policy, epsilon
        self.cdm = tables if isinstance(tables, Cdm) else Cdm(spark, "", dict(tables))
        self.names = _names(self.cdm) if isinstance(tables, Cdm) else list(tables)
        self._tables = {n: self.cdm.table(n) for n in self.names}
        self.blueprint = Blueprint(self._tables)
        self.secret = secret or secrets.token_bytes(32)
        self.grids, self.definitions = dict(grids or {}), definitions
        self.frames: dict[str, DataFrame] = {}
        self.audit: list[dict] = []
        self._edges: dict[str, tuple[float, list[float]]] = {}
        self.registry: dict[str, Entry] = {e.name: e for e in entries()}

    # Release.

    def _note(self, call: str, **what) -> None:
        self.audit.append({"at": time.time(), "call": call, **what})

    def release(self, df: DataFrame, unit: str, counts: Sequence[str], call: str, **options) -> DataFrame:
        """df through the gate, with a line in the audit log."""
        self._note(call, unit=unit, counts=list(counts))
        return gate(df, unit, list(counts), self.policy, **options)

    def released(self, df: DataFrame, call: str) -> DataFrame:
        """An aggregate whose counts are told by their names; one that counts records only is refused."""
        people = [c for c in PERSON_COUNTS if c in df.columns]
        counted = [c for c in RECORD_COUNTS if c in df.columns]
        if not people:
            raise DisclosureError("record counts need person counts")
        return self.release(df, "record" if counted else "person", [*people[1:], *counted] if counted else people, call, companion=people[0] if counted else None)

    def disclosure_settings(self) -> dict:
        """The thresholds."""
        return asdict(self.policy)

    # The database.

    def ping(self) -> dict:
        """Whether the session is there, and what it can do."""
        return {"ok": True, "spark": self.spark.version, "calls": sorted(n for n in dir(type(self)) if not n.startswith("_"))}

    def capabilities(self) -> dict:
        """Version, tables and analyses."""
        return {"version": self.cdm_version(), "tables": self.list_tables(), "analyses": self.analysis_list(), "templates": self.query_list(), "standard": sorted(standard.catalog())}

    def list_tables(self) -> list[dict]:
        """Tables with what they are."""
        return [{"table": t.name, "category": t.category, "has_person": t.has_person, "concept_column": t.concept_column, "date_column": t.date_column} for t in self.blueprint.tables.values()]

    def list_columns(self, table: str) -> list[dict]:
        """Columns of a table that may be seen."""
        return [{"column": c.name, "type": c.type, "role": c.role, "is_date": c.is_date} for c in self._info(table).columns if not c.sensitive]

    def relationship_graph(self) -> list[dict]:
        """Links between tables."""
        return profile.relationship_graph(self.blueprint.links)

    def cdm_source(self) -> list[dict]:
        """The database's own description."""
        return [r.asDict() for r in self._tables["cdm_source"].limit(10).collect()] if "cdm_source" in self._tables else []

    def cdm_version(self) -> str | None:
        """The model's version."""
        return self.blueprint.version(self._tables)

    def _info(self, table: str):
        if table not in self.blueprint:
            raise SpecError(f"no table {table}")
        return self.blueprint[table]

    def _seen(self, table: str, column: str) -> DataFrame:
        """A table, after it was checked that the column may be released."""
        found = self._info(table).column(column)
        if found is None or found.sensitive or column == "person_id":
            raise SpecError(f"{column} is not released")
        return self._tables[table]

    # Profiles.

    def table_stats(self, table: str) -> DataFrame:
        """Rows and persons of a table."""
        self._info(table)
        return self.released(profile.table_stats(self._tables[table]), "table_stats")

    def column_stats(self, table: str, columns: Sequence[str]) -> DataFrame:
        """Rows, missing values, distinct values and persons of columns."""
        for c in columns:
            self._seen(table, c)
        return self.release(profile.column_stats(self._tables[table], columns), "record", ["n_total"], "column_stats", companion="n_persons").withColumn("n_missing", band(F.col("n_missing"), self.policy.band))

    def domain_coverage(self, tables: Sequence[str]) -> DataFrame:
        """Persons by table."""
        return self.released(profile.domain_coverage(self.cdm, [t for t in tables if self._info(t).has_person]), "domain_coverage")

    def missingness(self, table: str, columns: Sequence[str]) -> DataFrame:
        """Persons without any value, by column, and their banded share."""
        for c in columns:
            self._seen(table, c)
        found = profile.missingness(self._tables[table], columns, band=self.policy.band)
        return self.release(found, "person", ["n_persons"], "missingness").withColumn("n_missing", F.when(F.col("n_missing") >= self.policy.tab, band(F.col("n_missing"), self.policy.band)))

    def value_counts(self, table: str, column: str, top: int = 20) -> DataFrame:
        """The values of a column of few levels with most persons; names for concepts."""
        df = self._seen(table, column)
        safe_levels(df, column, self.policy)
        return self.released(profile.top_values(df, column, top, self.policy), "value_counts")

    def concept_prevalence(self, table: str, cohort: DataFrame | None = None, offset: int = 0, limit: int = 100) -> DataFrame:
        """Persons and records by concept with their names, in banded order."""
        info = self._info(table)
        df = self._tables[table] if cohort is None else filters.in_cohort(self._tables[table], cohort)
        assert_min_persons(df, self.policy)
        self._note("concept_prevalence", table=table)
        found = profile.prevalence(df, info.concept_column, self.policy, offset=offset, limit=limit)
        return templates.named(found, self.cdm, "concept_id", "concept_name", "left")

    def cross_tab(self, table: str, row: str, column: str, strata: str | None = None) -> DataFrame:
        """Persons by pairs of levels, small cells and their complements hidden."""
        for c in [row, column, *([strata] if strata else [])]:
            self._seen(table, c)
        self._note("cross_tab", table=table)
        return profile.crosstab(self._tables[table], row, column, self.policy, strata=strata)

    def numeric_range(self, table: str, column: str) -> DataFrame:
        """The 5th and 95th percentile, tails protected."""
        self._note("numeric_range", table=table)
        return profile.numeric_range(self._seen(table, column), column, self.policy)

    def numeric_quantiles(self, table: str, column: str, probabilities: Sequence[float] = (0.25, 0.5, 0.75)) -> DataFrame:
        """Quantiles at real rows, tails protected."""
        self._note("numeric_quantiles", table=table)
        return profile.offset_quantiles(self._seen(table, column), column, probabilities, self.policy.tab)

    def numeric_histogram(self, table: str, column: str, bins: int = 10, breaks: Sequence[float] | None = None) -> DataFrame:
        """Counts by bin: of equal width over the numeric range, or between shared breaks; small bins go."""
        df = self._seen(table, column)
        if breaks is None:
            row = profile.numeric_range(df, column, self.policy).first()
            if row is None:
                raise DisclosureError("too few persons")
            breaks = profile.equal_breaks(row["p05"], row["p95"], bins)
        return self.released(profile.histogram(df, column, list(breaks)), "numeric_histogram")

    def date_counts(self, table: str, unit: str = "year") -> DataFrame:
        """Records and persons by year, quarter or month of the event date."""
        return self.released(profile.date_counts(self._tables[table], self._info(table).date_column, unit), "date_counts")

    def drilldown(self, table: str, concept: int) -> dict[str, DataFrame]:
        """What is known of one concept."""
        info, df = self._info(table), self._tables[table]
        assert_min_persons(df.where(F.col(info.concept_column) == concept), self.policy)
        self._note("drilldown", table=table, concept=concept)
        return profile.drilldown(df, info.concept_column, concept, self.policy, value="value_as_number" if info.column("value_as_number") else None, date=info.date_column, category=next((c.name for c in info.columns if c.role == "type_concept"), None))

    def locate_concept(self, ids: Sequence[int]) -> DataFrame:
        """Every table and concept column that holds given concepts."""
        where = [(t.name, c.name) for t in self.blueprint.tables.values() if t.has_person and t.category == "clinical" for c in t.columns if c.name.endswith("_concept_id") and not c.sensitive]
        return self.released(profile.locate(self.cdm, ids, where), "locate_concept")

    def safe_cutpoints(self, table: str, column: str) -> list[float] | None:
        """The server's grid for a column, if each of its bins holds enough persons; filters may use its edges for a while."""
        grid = self.grids.get(f"{table}.{column}")
        found = profile.safe_cutpoints(self._seen(table, column), column, grid, self.policy) if grid else None
        if found:
            self._edges[column] = (time.time() + EDGES_HOLD, found)
        return found

    def issued(self) -> dict[str, list[float]]:
        """Edges that still hold, by column."""
        return {c: edges for c, (until, edges) in self._edges.items() if until > time.time()}

    # Vocabulary.

    def search_concepts(self, text: str, **facets) -> DataFrame:
        """Concepts whose names hold all words."""
        return concepts.search(self.cdm, text, **facets)

    def lookup_concepts(self, ids: Sequence[int]) -> DataFrame:
        """Concepts by id."""
        return concepts.lookup(self.cdm, list(ids))

    def descendants(self, ids: Sequence[int], with_self: bool = True) -> DataFrame:
        """Concepts below."""
        return concepts.descendants(self.cdm, concepts.ids(self.cdm, list(ids)), with_self)

    def ancestors(self, ids: Sequence[int]) -> DataFrame:
        """Concepts above."""
        return concepts.ancestors(self.cdm, concepts.ids(self.cdm, list(ids)))

    def expand_concept_set(self, spec: concepts.ConceptSet | Sequence[int]) -> DataFrame:
        """A concept set, or a flat list of ids, as ids; at most MAX_SET of them."""
        out = concepts.expand(self.cdm, spec if isinstance(spec, concepts.ConceptSet) else concepts.ConceptSet(tuple(spec)))
        if out.limit(concepts.MAX_SET + 1).count() > concepts.MAX_SET:
            raise SpecError("the concept set is too large")
        return out

    def synonyms(self, ids: Sequence[int]) -> DataFrame:
        """Other names."""
        return concepts.synonyms(self.cdm, concepts.ids(self.cdm, list(ids)))

    def relationships(self, ids: Sequence[int], relation: str | None = None) -> DataFrame:
        """Relations, forward and reverse."""
        return concepts.relationships(self.cdm, concepts.ids(self.cdm, list(ids)), relation)

    def list_concepts(self, offset: int = 0, limit: int = 100, **facets: str) -> tuple[int, DataFrame]:
        """How many concepts there are with some facets, and a page of them."""
        return concepts.browse(self.cdm, offset, limit, **facets)

    def _distinct(self, table: str, column: str) -> DataFrame:
        """A metadata table of its own, or what the concepts name."""
        return self._tables[table] if table in self._tables else self.cdm.concept.select(column).where(F.col(column).isNotNull()).distinct()

    def vocabularies(self) -> DataFrame:
        """Vocabularies."""
        return self._distinct("vocabulary", "vocabulary_id")

    def domains(self) -> DataFrame:
        """Domains."""
        return self._distinct("domain", "domain_id")

    def concept_classes(self) -> DataFrame:
        """Classes of concepts."""
        return self._distinct("concept_class", "concept_class_id")

    # Cohorts and frames.

    def cohort(self, reference: str | int | None) -> DataFrame:
        """A cohort by the name of a kept frame, by stored id, or all observation periods."""
        if reference is None:
            return cohorts.everyone(self.cdm)
        if isinstance(reference, int):
            return cohorts.stored(self.cdm, reference)
        if reference not in self.frames:
            raise SpecError(f"nothing is kept as {reference}")
        return self.frames[reference].select(*cohorts.COHORT)

    def cohort_create(self, name: str, spec: dict) -> None:
        """Keeps a population's episodes."""
        self._keep(name, outputs.populations(self.cdm, Plan({name: spec}))[name], "subject_id")

    def cohort_combine(self, name: str, op: str, members: Sequence[str | int]) -> None:
        """Keeps the combination of cohorts; of one cohort with itself without a join."""
        if len(set(members)) == 1 and op in ("intersect", "union"):
            self._keep(name, self.cohort(members[0]), "subject_id")
        else:
            self._keep(name, cohorts.combine(op, [self.cohort(m) for m in members]), "subject_id")

    def cohort_from_table(self, name: str, frame: str) -> None:
        """Keeps the observation periods of a kept frame's persons, told by their tokens."""
        person = tokens.reverse(self.frames[frame], self.secret)
        self._keep(name, verbs.to_cohort(person, self.cdm.observation_period), "subject_id")

    def cohort_list(self) -> DataFrame:
        """Stored cohorts with enough persons, and their names."""
        counts = self.cdm.cohort.groupBy("cohort_definition_id").agg(F.count(F.lit(1)).alias("entries"), F.countDistinct("subject_id").alias("subjects"))
        out = self.released(counts, "cohort_list")
        return out if self.definitions is None else out.join(self.definitions.select("cohort_definition_id", "cohort_definition_name"), "cohort_definition_id", "left")

    def cohort_definition(self, definition: int) -> dict | None:
        """The definition of a stored cohort that has enough persons."""
        assert_min_persons(cohorts.stored(self.cdm, definition), self.policy, "subject_id")
        row = self.definitions.where(F.col("cohort_definition_id") == definition).first() if self.definitions is not None else None
        return row.asDict() if row else None

    def _keep(self, name: str, df: DataFrame, person: str = "person_id") -> None:
        if person in df.columns:
            assert_min_persons(df, self.policy, person)
        self.frames[name] = df
        self._note("keep", name=name)

    def _keep_tokens(self, name: str, df: DataFrame) -> None:
        """Keeps an output with its persons as tokens."""
        for person in ("person_id", "subject_id"):
            if person in df.columns:
                df = tokens.tokenise(df, self.secret, person)
        self.frames[name] = df
        self._note("keep", name=name)

    def plan_preview(self, plan: Plan) -> list[dict]:
        """What a plan would make."""
        return outputs.preview(plan)

    def plan_execute(self, plan: Plan) -> list[str]:
        """Keeps a plan's outputs under their names, persons as tokens."""
        for name, df in outputs.run(self.cdm, plan, self.policy).items():
            self._keep_tokens(name, df)
        return list(plan.outputs)

    def stage(self, name: str, path: str, form: str = "parquet", contract: dict | None = None) -> dict:
        """Writes a kept frame to a path, with its manifest."""
        self._note("stage", name=name)
        return sinks.write_output(self.frames[name], path, form, contract)

    def staged_dataset_path(self, root: str, name: str, contract: dict | None = None) -> str:
        """Where a staged output is, if it may still be read."""
        return sinks.staged_path(self.spark, root, name, contract)

    def extract(self, name: str, table: str, **how) -> None:
        """Keeps rows of a table, persons as tokens."""
        self._keep_tokens(name, extract(self._tables, self.blueprint, table, issued=self.issued(), policy=self.policy, **how))

    def filter(self, name: str, frame: str, column: str, op: str, value) -> None:
        """Keeps rows of a frame by a test of a text column."""
        self.frames[name] = verbs.filter_rows(self.frames[frame], column, op, value, self.policy)

    def select(self, name: str, frame: str, columns: Sequence[str]) -> None:
        """Keeps some columns of a frame."""
        self.frames[name] = verbs.select_columns(self.frames[frame], columns)

    def merge(self, name: str, a: str, b: str, keys: Sequence[str] = ("person_id",), how: str = "inner") -> None:
        """Keeps the join of two frames."""
        self._keep(name, verbs.merge(self.frames[a], self.frames[b], keys, how))

    def bind_rows(self, name: str, frames: Sequence[str]) -> None:
        """Keeps the rows of several frames."""
        self.frames[name] = verbs.bind_rows([self.frames[f] for f in frames], self.policy)

    def factor_levels(self, frame: str, column: str) -> list[str]:
        """The levels of a text column, if they are few and none is a person's own."""
        df = self.frames[frame]
        safe_levels(df, column, self.policy)
        held = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.countDistinct("person_id").alias("n")).where(F.col("n") >= self.policy.tab)
        return sorted(str(r[column]) for r in held.select(column).collect())

    def as_factor(self, name: str, frame: str, column: str, levels: Sequence[str], other: str | None = None) -> None:
        """Keeps a frame with a column on agreed levels."""
        self.frames[name] = verbs.recode(self.frames[frame], column, levels, other)

    def cleanup(self, names: Sequence[str] | None = None) -> None:
        """Forgets kept frames."""
        for n in list(self.frames) if names is None else names:
            self.frames.pop(n, None)

    # Templates and analyses.

    def query_list(self) -> list[dict]:
        """Templates and whether they may be run."""
        return [{"id": t.id, "safety": t.safety} for t in templates.catalog().values()]

    def query_get(self, id_: str) -> dict:
        """One template."""
        t = templates.catalog()[id_]
        return {"id": t.id, "safety": t.safety, "sql": t.sql}

    def query_exec(self, id_: str) -> DataFrame:
        """A template's result, released; blocked ones, and rows of persons, are refused."""
        t = templates.catalog()[id_]
        if t.safety != "SAFE_AGGREGATE":
            raise DisclosureError(f"{id_} is not released")
        return self.released(t.build(self.cdm), f"query {id_}")

    def query_assign(self, name: str, id_: str) -> None:
        """Keeps the rows of a template that may stay with the server."""
        t = templates.catalog()[id_]
        if t.safety != "SAFE_ASSIGN":
            raise DisclosureError(f"{id_} has no rows to keep")
        self._keep_tokens(name, t.build(self.cdm))

    def analysis_list(self) -> list[str]:
        """Names of analyses."""
        return sorted(self.registry)

    def analysis_get(self, name: str) -> dict:
        """What an analysis counts, needs and takes."""
        e = self._entry(name)
        return {"name": e.name, "unit": e.unit, "scoped": e.scoped, "counts": list(e.counts), "parameters": dict(e.parameters), "combine": e.combine}

    def pooling_contract(self, name: str) -> dict[str, str]:
        """How the counts and ratios of an analysis combine over sites."""
        e = self._entry(name)
        return pooling_contract(e.unit, [*e.counts, *([e.companion] if e.companion else [])], dict(e.ratios))

    def _entry(self, name: str) -> Entry:
        if name not in self.registry:
            raise SpecError(f"no analysis {name}")
        return self.registry[name]

    def register(self, entry: Entry) -> None:
        """Adds an analysis of one's own; it must say which columns it gives and what they count."""
        if entry.name in self.registry:
            raise SpecError(f"{entry.name} is taken")
        if not entry.columns or not entry.counts or entry.unit not in ("person", "record", "dist") or entry.unit == "record" and not entry.companion:
            raise SpecError("an analysis must name its columns, its counts, and for records its count of persons")
        self.registry[entry.name] = entry

    def analysis_run(self, name: str, cohort: str | int | None = None, top: int | None = None, **parameters) -> DataFrame:
        """An analysis, released: within a cohort if it takes one, at most top rows in order of banded support."""
        e = self._entry(name)
        if unknown := set(parameters) - set(e.parameters):
            raise SpecError(f"{name} has no parameter {sorted(unknown)[0]}")
        within = self.cohort(cohort) if e.scoped or cohort is not None else None
        if within is not None:
            assert_min_persons(within, self.policy, "subject_id")
        made = e.compute(self, within, dict(e.parameters) | parameters)
        if e.columns is not None and set(made.columns) != set(e.columns):
            raise DisclosureError("the result has other columns than it may")
        summary = [c for c in made.columns if c in ("avg_value", "stdev_value", *standard.QUANTILES)]
        out = self.release(made, e.unit, list(e.counts), f"analysis {name}", companion=e.companion, ratios=dict(e.ratios), summary=summary)
        first = e.companion or e.counts[0]
        return out if top is None else out.orderBy(F.desc(first), *[c for c in out.columns if c not in (first, *e.counts)]).limit(top)

    def analysis_run_assign(self, keep: str, name: str, **how) -> None:
        """Keeps an analysis' released result."""
        self.frames[keep] = self.analysis_run(name, **how)

    def standard_analysis(self, id_: int) -> DataFrame:
        """A standard analysis by number, released."""
        a = standard.catalog()[id_]
        df = a.build(self.cdm)
        summary = [c for c in df.columns if c in ("avg_value", "stdev_value", *standard.QUANTILES)]
        return self.release(df, a.unit, ["count_value"], f"standard {id_}", companion="n_persons" if a.unit == "record" and "n_persons" in df.columns else None, summary=summary)

    def score(self, name: str, reference_year: int) -> DataFrame:
        """Distribution of a named score over persons, released: persons by value."""
        found = features.score(self.cdm, scores.SCORES[name], reference_year)
        return self.released(found.groupBy("score").agg(F.countDistinct("person_id").alias("n_persons")), f"score {name}")

    # Results that other tools have computed.

    def achilles_status(self) -> dict:
        """Which precomputed tables there are."""
        return {t: t in self._tables for t in ("achilles_analysis", "achilles_results", "achilles_results_dist", "achilles_heel_results")}

    def achilles_analyses(self) -> DataFrame:
        """What was precomputed."""
        return results.analyses(self._tables)

    def achilles_catalog(self) -> list[dict]:
        """The standard analyses that can be computed here."""
        return [{"analysis_id": a.id, "unit": a.unit} for a in standard.catalog().values()]

    def achilles_results(self, ids: Sequence[int], first_stratum: Sequence[str] | None = None) -> DataFrame:
        """Precomputed counts."""
        self._note("achilles_results", ids=list(ids))
        return results.counts(self._tables, ids, self.policy, first_stratum)

    def achilles_distribution(self, ids: Sequence[int]) -> DataFrame:
        """Precomputed distributions."""
        self._note("achilles_distribution", ids=list(ids))
        return results.distributions(self._tables, ids, self.policy)

    def achilles_warnings(self, ids: Sequence[int] | None = None) -> DataFrame:
        """Data-quality warnings."""
        return results.warnings(self._tables, ids)

    def tool_status(self) -> dict:
        """Tools whose result tables there are."""
        return {tool: [t for x, t in results.known_tables(self._tables) if x == tool] for tool in sorted({x for x, _ in results.known_tables(self._tables)})}

    def tool_tables(self) -> list[tuple[str, str]]:
        """Result tables by tool."""
        return results.known_tables(self._tables)

    def tool_contract(self, table: str) -> dict:
        """What may be released of a result table."""
        return asdict(results.contract(table))

    def tool_results(self, table: str, **equal) -> DataFrame:
        """Rows of a result table, released."""
        results.contract(table)
        self._note("tool_results", table=table)
        return results.tool_results(self._tables, table, self.policy, **equal)

    def tool_summary(self) -> list[dict]:
        """Tables and public columns."""
        return results.summary(self._tables)

    # Noisy releases.

    def noise_status(self) -> dict:
        """How noise is made."""
        return {"mechanism": "discrete Laplace", "epsilon": self.epsilon, "statistics": sorted(STATISTICS), "repeat": "the same question has the same answer"}

    def noise_catalog(self) -> list[dict]:
        """Which statistics can be asked of which columns, by the columns' types."""
        out = []
        for t in self.blueprint.tables.values():
            if t.has_person and t.category == "clinical":
                out += [{"table": t.name, "column": None, "statistic": x} for x in ("count", "bounded_record_count")]
                for c in t.columns:
                    if not c.sensitive and c.name != "person_id" and not (c.name.endswith("_id") and c.role == "non_concept"):
                        kinds = ("date_histogram",) if c.is_date else ("categorical_histogram", "bounded_distinct") if c.role != "non_concept" or c.type == "string" else ("numeric_histogram", "bounded_mean")
                        out += [{"table": t.name, "column": c.name, "statistic": x} for x in kinds]
        return out

    def seal(self, name: str, recipe: dict) -> str:
        """Proof that a kept frame is what a recipe made of it."""
        return noise.seal(self.frames[name], self.secret, recipe)

    def verify(self, name: str, recipe: dict, proof: str) -> bool:
        """Whether a kept frame still is what was sealed."""
        return noise.verified(self.frames[name], self.secret, recipe, proof)

    def noise_release(self, statistic: str, table: str, column: str | None = None, **how) -> DataFrame:
        """A person-bounded statistic with keyed noise."""
        if statistic not in STATISTICS:
            raise SpecError(f"no statistic {statistic}")
        build, columns, labels, sensitivity = STATISTICS[statistic]
        df = self._tables[table] if column is None else self._seen(table, column)
        query = {"statistic": statistic, "table": table, "column": column, **{k: list(v) if isinstance(v, (list, tuple)) else v for k, v in how.items()}}
        self._note("noise_release", statistic=statistic, table=table)
        epsilon = self.epsilon / len(columns)
        return noise.release(build(df, column, how), self.secret, query, epsilon, columns, labels, sensitivity(how))


#: Noisy statistics: plan, value columns, label columns, and how much one person can change.
STATISTICS: dict[str, tuple] = {
    "count": (lambda df, c, h: noise.count_persons(df), ("value",), (), lambda h: 1),
    "bounded_record_count": (lambda df, c, h: noise.bounded_records(df, h["k"]), ("value",), (), lambda h: h["k"]),
    "categorical_histogram": (lambda df, c, h: noise.categorical_histogram(df, c, h["levels"], h.get("k", 1), [c]), ("value",), ("level",), lambda h: h.get("k", 1)),
    "numeric_histogram": (lambda df, c, h: noise.numeric_histogram(df, c, h["breaks"], h.get("how", "mean")), ("value",), ("bin",), lambda h: 1),
    "date_histogram": (lambda df, c, h: noise.date_histogram(df, c, h["breaks"], h.get("how", "min"), kind=h.get("kind", "date")), ("value",), ("bin",), lambda h: 1),
    "bounded_distinct": (lambda df, c, h: noise.bounded_distinct(df, c, h["k"]), ("value",), (), lambda h: h["k"]),
    "bounded_mean": (lambda df, c, h: noise.bounded_mean(df, c, h["low"], h["high"], h.get("how", "mean")), ("n", "total"), (), lambda h: {"n": 1, "total": noise.GRID}),
    "binary_rate": (lambda df, c, h: noise.binary_rate(df, c, h.get("how", "any")), ("numerator", "denominator"), (), lambda h: 1),
}


def _names(cdm: Cdm) -> list[str]:
    return list(views("spark"))
