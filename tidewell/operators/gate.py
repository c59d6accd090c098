"""Disclosure control: every released result goes through one gate."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Policy:
    """Thresholds of the release gate."""

    subset: int = 3
    tab: int = 3
    levels: int = 40
    level_density: float = 0.33
    dist: int = 10
    band: int = 5
    age_band: int = 5
    date_days: int = 30
    text: int = 80


class DisclosureError(ValueError):
    """A result too small to release; says no more than that."""


def assert_min_persons(df: DataFrame, policy: Policy = Policy(), person: str = "person_id") -> None:
    """Raises unless enough distinct persons are behind df."""
    enough = df.select(person).where(F.col(person).isNotNull()).distinct().limit(policy.subset).count()
    if enough < policy.subset:
        raise DisclosureError("too few persons")


def band(count: Column, width: int) -> Column:
    """The count floored to a multiple of width."""
    return (F.floor(count / width) * width).cast("long")


def drop_small(df: DataFrame, counts: list[str], policy: Policy = Policy()) -> DataFrame:
    """Rows of which every count reaches the threshold; a null count drops its row."""
    for c in counts:
        df = df.where(F.col(c) >= policy.tab)
    return df


def gate(df: DataFrame, unit: str, counts: list[str], policy: Policy = Policy(), companion: str | None = None, basis: list[str] | None = None, summary: list[str] | None = None, ratios: dict[str, tuple[str, str]] | None = None, strict: bool = True) -> DataFrame:
    """Suppresses on exact counts, then bands them, then mends ratios.

    unit is person, record or dist.  Record results need a companion column of
    persons, on which rows are dropped first.  Distribution results lose columns
    named like a minimum or maximum, and all their summary columns are nulled
    where any basis count is below the distribution threshold.  A ratio whose
    banded numerator is 0 becomes null.  Source values and flags of suppression
    go; texts over the policy's length are null.
    """
    df = df.drop(*[c for c in df.columns if c.endswith(("_source_value", "_source_concept_id")) or c == "suppressed"])
    df = df.withColumns({c: F.when(F.char_length(c) <= policy.text, F.col(c)) for c, t in df.dtypes if t == "string"})
    if unit == "record":
        if companion is None and strict:
            raise DisclosureError("record counts need person counts")
        if companion is not None:
            df = drop_small(df, [companion], policy)
    if unit == "dist":
        df = df.drop(*[c for c in df.columns if c.split("_")[0] in ("min", "max") or c in ("minimum", "maximum")])
        low = F.lit(False)
        for c in basis or counts:
            low = low | F.coalesce(F.col(c) < policy.dist, F.lit(True))
        for c in summary or []:
            df = df.withColumn(c, F.when(~low, F.col(c)))
    df = drop_small(df, counts, policy)
    df = df.withColumns({c: band(F.col(c), policy.band) for c in [*counts, *([companion] if companion and companion not in counts else [])]})
    for name, (top, bottom) in (ratios or {}).items():
        df = df.withColumn(name, F.when((F.col(top) > 0) & (F.col(bottom) > 0), F.col(top) / F.col(bottom)))
    return df


def pooling_contract(unit: str, counts: list[str], ratios: dict[str, tuple[str, str]] | None = None, values: list[str] | None = None) -> dict[str, str]:
    """How each column of a released result combines over sites: counts add up, ratios are made anew from them, other values stay apart."""
    out = {c: "sum" for c in counts} | {c: f"{top} / {bottom}" for c, (top, bottom) in (ratios or {}).items()}
    return out | {c: "keep by site" if unit == "dist" else "key" for c in values or [] if c not in out}


def pooled(frames: list[DataFrame], contract: dict[str, str]) -> DataFrame:
    """Released results of several sites in one, as their contract says; what a site has suppressed counts as nothing."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    keys = [c for c in out.columns if contract[c] == "key"]
    made = out.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in out.columns if contract[c] == "sum"])
    for c, how in contract.items():
        if " / " in how:
            top, bottom = how.split(" / ")
            made = made.withColumn(c, F.when((F.col(top) > 0) & (F.col(bottom) > 0), F.col(top) / F.col(bottom)))
    return made.select(*[c for c in out.columns if contract[c] != "keep by site"])


def banded_top_n(df: DataFrame, n: int, by: str, keys: list[str], policy: Policy = Policy()) -> DataFrame:
    """The n rows of highest banded support, ties by public keys."""
    return df.orderBy(F.desc(band(F.col(by), policy.band)), *keys).limit(n)


def safe_levels(df: DataFrame, column: str, policy: Policy = Policy(), person: str = "person_id") -> None:
    """Raises where a column has too many levels, or too many for the persons behind it."""
    row = df.where(F.col(column).isNotNull()).agg(F.countDistinct(column).alias("n"), F.countDistinct(person).alias("p")).first()
    if row["n"] > policy.levels or row["p"] and row["n"] / row["p"] > policy.level_density:
        raise DisclosureError("too many levels")


def age_bands(ages: DataFrame, age: str = "age", person: str = "person_id", policy: Policy = Policy()) -> DataFrame:
    """ages with age_group on the grid of the policy; groups of too few persons become null."""
    low = (F.floor(F.col(age) / policy.age_band) * policy.age_band).cast("long")
    marked = ages.withColumn("_low", F.when(F.col(age) >= 0, low))
    support = marked.groupBy("_low").agg(F.countDistinct(person).alias("_n")).where(F.col("_n") >= policy.tab)
    label = F.concat(F.col("_low").cast("string"), F.lit("-"), (F.col("_low") + policy.age_band - 1).cast("string"))
    return marked.join(F.broadcast(support), "_low", "left").withColumn("age_group", F.when(F.col("_n").isNotNull(), label)).drop("_low", "_n")


def complementary(matrix: list[list[int | None]], small: int) -> list[list[int | None]]:
    """A count matrix with small cells hidden, and more, until no line has just one hidden non-zero cell.

    Zero and hidden cells are both None.  Rows are mended before columns, each
    time by hiding the smallest visible cell of the line, until nothing changes.
    The matrix is one released cross-table, of at most a few dozen levels a side.
    """
    hidden = {(r, c) for r, line in enumerate(matrix) for c, v in enumerate(line) if v and v < small}
    shape = (len(matrix), len(matrix[0]) if matrix else 0)
    lines = [[(r, c) for c in range(shape[1])] for r in range(shape[0])] + [[(r, c) for r in range(shape[0])] for c in range(shape[1])]
    changed = True
    while changed:
        changed = False
        for line in lines:
            if sum(cell in hidden for cell in line) == 1:
                visible = [cell for cell in line if cell not in hidden and matrix[cell[0]][cell[1]]]
                if visible:
                    hidden.add(min(visible, key=lambda x: (matrix[x[0]][x[1]], x)))
                    changed = True
    return [[None if (r, c) in hidden or not v else v for c, v in enumerate(line)] for r, line in enumerate(matrix)]
