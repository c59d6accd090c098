"""Vocabulary operators: search, hierarchy, mappings and concept sets, as joins on the closed tables."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.cdm import Cdm

MAX_SEARCH, MAX_PAGE, MAX_SET = 500, 1000, 10_000


@dataclass(frozen=True)
class ConceptSet:
    """Concepts with what to add to and take from them."""

    concepts: tuple[int, ...]
    include_descendants: bool = False
    include_mapped: bool = False
    exclude: tuple[int, ...] = field(default=())


def ids(cdm: Cdm, values: list[int] | tuple[int, ...]) -> DataFrame:
    """A frame of concept ids."""
    return cdm.spark.createDataFrame([(int(v),) for v in values], "concept_id long")


def search(cdm: Cdm, text: str, domain: str | None = None, vocabulary: str | None = None, standard: bool | None = None, limit: int = MAX_SEARCH) -> DataFrame:
    """Concepts whose name holds every word of the text, whatever the case."""
    out = cdm.concept
    for word in text.lower().split():
        out = out.where(F.lower("concept_name").contains(word))
    for column, value in (("domain_id", domain), ("vocabulary_id", vocabulary)):
        if value is not None:
            out = out.where(F.col(column) == value)
    if standard is not None:
        out = out.where((F.col("standard_concept") == "S") == standard)
    return out.orderBy("concept_id").limit(min(limit, MAX_SEARCH))


def lookup(cdm: Cdm, values: list[int]) -> DataFrame:
    """Concepts by id."""
    return cdm.concept.where(F.col("concept_id").isin(values))


def descendants(cdm: Cdm, values: DataFrame, with_self: bool = True) -> DataFrame:
    """(ancestor, descendant, levels) below given concepts."""
    a = cdm.concept_ancestor.where(F.col("min_levels") >= (0 if with_self else 1))
    return a.join(values.select(F.col("concept_id").alias("ancestor_concept_id")), "ancestor_concept_id", "left_semi")


def ancestors(cdm: Cdm, values: DataFrame, with_self: bool = False) -> DataFrame:
    """(ancestor, descendant, levels) above given concepts."""
    a = cdm.concept_ancestor.where(F.col("min_levels") >= (0 if with_self else 1))
    return a.join(values.select(F.col("concept_id").alias("descendant_concept_id")), "descendant_concept_id", "left_semi")


def hierarchy(cdm: Cdm, values: DataFrame) -> DataFrame:
    """Both directions in one frame."""
    up = ancestors(cdm, values).select(F.lit("ancestor").alias("direction"), F.col("ancestor_concept_id").alias("concept_id"), "min_levels")
    down = descendants(cdm, values, False).select(F.lit("descendant").alias("direction"), F.col("descendant_concept_id").alias("concept_id"), "min_levels")
    return up.unionByName(down).distinct()


def mapped_sources(cdm: Cdm, values: DataFrame) -> DataFrame:
    """Source concepts that map to given ones, by valid relations."""
    r = cdm.concept_relationship.where("relationship_id = 'Maps to' AND invalid_reason IS NULL")
    return r.join(values.select(F.col("concept_id").alias("concept_id_2")), "concept_id_2", "left_semi").select(F.col("concept_id_1").alias("concept_id")).distinct()


def expand(cdm: Cdm, spec: ConceptSet) -> DataFrame:
    """The flat ids of a concept set: concepts, descendants, mapped sources, less the excluded (and their descendants)."""
    def below(values: DataFrame) -> DataFrame:
        return values.unionByName(descendants(cdm, values).select(F.col("descendant_concept_id").alias("concept_id"))).distinct() if spec.include_descendants else values.distinct()

    out = below(ids(cdm, spec.concepts))
    if spec.include_mapped:
        out = out.unionByName(mapped_sources(cdm, out)).distinct()
    if spec.exclude:
        out = out.join(below(ids(cdm, spec.exclude)), "concept_id", "left_anti")
    return out


def relationships(cdm: Cdm, values: DataFrame, relation: str | None = None) -> DataFrame:
    """Relations of given concepts, forward and reverse."""
    r = cdm.concept_relationship
    if relation is not None:
        r = r.where(F.col("relationship_id") == relation)
    v = values.select(F.col("concept_id").alias("_v"))
    forward = r.join(v, F.col("concept_id_1") == F.col("_v"), "left_semi").select(F.lit("forward").alias("direction"), F.col("concept_id_1").alias("concept_id"), F.col("concept_id_2").alias("related_id"), "relationship_id")
    reverse = r.join(v, F.col("concept_id_2") == F.col("_v"), "left_semi").select(F.lit("reverse").alias("direction"), F.col("concept_id_2").alias("concept_id"), F.col("concept_id_1").alias("related_id"), "relationship_id")
    return forward.unionByName(reverse)


def synonyms(cdm: Cdm, values: DataFrame) -> DataFrame:
    """Other names of given concepts."""
    return cdm.concept_synonym.join(values, "concept_id", "left_semi")


def browse(cdm: Cdm, offset: int = 0, limit: int = MAX_PAGE, **facets: str) -> tuple[int, DataFrame]:
    """The number of concepts with given facets, and a page of them in order of id."""
    out = cdm.concept
    for column, value in facets.items():
        out = out.where(F.col(column) == value)
    return out.count(), out.orderBy("concept_id").offset(offset).limit(min(limit, MAX_PAGE))


def facets(cdm: Cdm) -> DataFrame:
    """Vocabularies and domains with their sizes."""
    v = cdm.concept.groupBy(F.col("vocabulary_id").alias("value")).agg(F.count(F.lit(1)).alias("n")).withColumn("facet", F.lit("vocabulary"))
    d = cdm.concept.groupBy(F.col("domain_id").alias("value")).agg(F.count(F.lit(1)).alias("n")).withColumn("facet", F.lit("domain"))
    return v.unionByName(d)


def translate(df: DataFrame, cdm: Cdm, columns: list[str]) -> DataFrame:
    """df with the names of concept columns beside them."""
    for c in columns:
        names = cdm.concept.select(F.col("concept_id").alias("_id"), F.col("concept_name").alias(c.replace("_concept_id", "_name")))
        df = df.join(names, F.col(c) == F.col("_id"), "left").drop("_id")
    return df
