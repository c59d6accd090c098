"""Near duplicates from bottom-k sketches of one hash function.

Texts with equal shingle sets fall into one class, which one document stands
for.  A class's sketch is the SKETCH smallest hashes of its set.  Its retained
values are ordered by the number of sketches that hold them, rarest first, and
the first keys_needed() of them are its keys, those that it alone holds counted
but left out; inverted lists of the keys bring candidates together.  Candidates
are filtered by the similarity estimated from the union of the two sketches,
and confirmed on the full shingle sets of both texts.

The order is one for all sketches, so the values before the first one that two
sketches share are in one of them only.  Two sets of the wanted similarity have
more such values than keys, on either side, with probability below 2 * MISS
(4e-9; never where both fit their sketches), whatever else is in the table.  At
0.8 they fall under the estimate's floor with probability below 2e-8.

Lists of up to SHORT entries give all their pairs.  A longer list is never
paired out: each member A is held against one pivot H, on full sets, and then
stands in for itself by its differences from H.  For two members

    |A ^ B| = |A ^ H| + |B ^ H| - 2 * |(A ^ H) & (B ^ H)|

so A and B can only be similar if their differences from H overlap in at least
half (|A ^ H| + |B ^ H| - c * (|A| + |B|)) elements, c = (1 - s) / (1 + s) for
similarity s.  Members of a crowd around H share most of their elements but few
of their differences, so the rarest of these, as many as the least overlap
leaves (a prefix), make short lists again.  Members far from H (below NEAR +
1 - s) keep their own sets in place of the differences; those from NEAR up have
the differences; two similar sets are both in one of the two kinds, because
1 - similarity is a metric.  Two members that are both linked to H need no pair.
Lists of differences of more than CROWD entries get a pivot in turn, LEVELS
times at most; then they are joined with the bounds on overlap alone, which
loses nothing.
"""

from __future__ import annotations

import functools
import hashlib
import math
from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .textcore import discard, mix64, saved, shingle_sets, slices, small_batches, words_of

SKETCH = 64
#: Probability allowed for each side of a pair that its keys end before the first shared value.
MISS = 2e-9
#: A value in more sketches than this is frequent: pivots hold many of them.
FREQUENT = 64
#: Estimates below this are no candidates; 0.8 lies about 6 standard deviations above.
FLOOR = 0.5
#: Longer lists of sketch values are held against a pivot.
SHORT = 16
#: Longer lists of differences get a pivot in turn, so often at most.
CROWD = 256
LEVELS = 3
#: Members of this similarity to a pivot are near it; estimates below NEAR_FLOOR count as far (3e-7 at NEAR).
NEAR = 0.5
NEAR_FLOOR = 0.2
#: Up to so many values or ids (8 bytes each) are sent to every executor; beyond, a shuffle join does the work.
BROADCAST_ROWS = 500_000

_SKETCHES = "id long, n_shingles long, d1 long, d2 long, sketch array<long>"
#: elements: a set, or its differences from a pivot, as keys that are distinct for each pivot (view).
_VIEWS = "id long, view long, n_all long, n_hub long, linked boolean, elements array<long>"


def _sketch(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                n, digests, ends, kept = [], [], [0], []
                for found in shingle_sets(words_of(batch.column("text")), size):
                    n.append(len(found))
                    digests.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest())
                    kept.append(found[:SKETCH])
                    ends.append(ends[-1] + len(kept[-1]))
                digest = np.frombuffer(b"".join(digests), dtype=np.int64).reshape(-1, 2)
                sketch = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([*kept, np.zeros(0, np.uint64)]).view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(n, pa.int64()), pa.array(digest[:, 0].copy()), pa.array(digest[:, 1].copy()), sketch], ["id", "n_shingles", "d1", "d2", "sketch"])

    return run


def estimates(a: pa.ListArray, b: pa.ListArray) -> np.ndarray:
    """Similarity of each pair of sketches (unsigned values, distinct): over the SKETCH smallest values of their union."""
    rows = len(a)
    values = np.full((rows, 2 * SKETCH), np.iinfo(np.uint64).max)
    used = np.zeros((rows, 2 * SKETCH), bool)
    for side, start in ((a, 0), (b, SKETCH)):
        ends = np.asarray(side.offsets).astype(np.int64)
        row = np.repeat(np.arange(rows), np.diff(ends))
        column = start + np.arange(ends[0], ends[-1]) - np.repeat(ends[:-1], np.diff(ends))
        values[row, column] = np.asarray(side.values)[ends[0] : ends[-1]].view(np.uint64)
        used[row, column] = True
    order = np.argsort(values, axis=1, kind="stable")
    values, used = np.take_along_axis(values, order, axis=1), np.take_along_axis(used, order, axis=1)
    again = np.zeros_like(used)
    again[:, 1:] = used[:, 1:] & used[:, :-1] & (values[:, 1:] == values[:, :-1])
    place = np.cumsum(used & ~again, axis=1)
    return (again & (place <= SKETCH)).sum(axis=1) / np.maximum(np.minimum(place[:, -1], SKETCH), 1)


def _estimated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(estimates(batch.column("sketch_a"), batch.column("sketch_b")))], ["a", "b", "alike"])


def _sets(column: pa.Array, size: int) -> list[np.ndarray]:
    """The shingle set of each text; texts that repeat, as pivots do, are read once."""
    each = column.fill_null("").dictionary_encode()
    found = list(shingle_sets(words_of(each.dictionary), size))
    return [found[k] for k in each.indices.to_pylist()]


def _both_sets(whole: pa.RecordBatch, size: int) -> Iterator[tuple[pa.RecordBatch, list[tuple[np.ndarray, np.ndarray]]]]:
    for part in slices(whole, "text_a"):
        for batch in slices(part, "text_b"):
            yield batch, list(zip(_sets(batch.column("text_a"), size), _sets(batch.column("text_b"), size)))


def _verified(size: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch, sets in _both_sets(whole, size):
                keep = []
                for k, (a, b) in enumerate(sets):
                    both = len(np.intersect1d(a, b, assume_unique=True))
                    if both and 100 * both >= percent * (len(a) + len(b) - both):
                        keep.append(k)
                yield batch.select(["a", "b"]).take(pa.array(keep, pa.int64()))

    return run


def _view_rows(rows: list[tuple]) -> pa.RecordBatch:
    """A batch of _VIEWS, and the pivot and whether the row is far from it."""
    ends = np.cumsum([0, *(len(r[5]) for r in rows)])
    elements = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.uint64), *(r[5] for r in rows)]).view(np.int64)))
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), None, pa.int64(), pa.bool_())
    return pa.RecordBatch.from_arrays([elements if t is None else pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], ["id", "view", "n_all", "n_hub", "linked", "elements", "hub", "far"])


def _centred(size: int, percent: int):
    """Members (a) against their pivots (b): linked or not, far or not, and the differences of those near."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch, sets in _both_sets(whole, size):
                rows = []
                for id_, hub, (a, h) in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), sets):
                    both = len(np.intersect1d(a, h, assume_unique=True))
                    union = len(a) + len(h) - both
                    alike = both / union if union else 0.0
                    view = np.frombuffer(hashlib.blake2b(h.tobytes(), digest_size=8).digest(), np.uint64)
                    apart = mix64(np.setxor1d(a, h, assume_unique=True) ^ mix64(view)) if alike >= NEAR else np.zeros(0, np.uint64)
                    rows.append((id_, int(view.view(np.int64)[0]), len(a), len(h), both > 0 and 100 * both >= percent * union, apart, hub, alike < NEAR + 1 - percent / 100))
                yield _view_rows(rows)

    return run


def _own(size: int):
    """Texts by their own sets: the view of those far from a pivot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                sets = shingle_sets(words_of(batch.column("text")), size)
                yield _view_rows([(id_, 0, len(a), 0, False, a, None, True) for id_, a in zip(batch.column("id").to_pylist(), sets) if len(a)])

    return run


def _shared_at_least(union: int, percent: int) -> int:
    """How many of the SKETCH smallest values of a union of this size both of two similar sets hold, but for MISS."""
    both, drawn = -(-percent * union // 100), min(SKETCH, union)
    ways, miss = math.comb(union, drawn), 0.0
    for x in range(max(0, drawn - union + both), drawn + 1):
        miss += math.comb(both, x) * math.comb(union - both, drawn - x) / ways
        if miss > MISS:
            return x
    return drawn


@functools.lru_cache
def keys_needed(percent: int) -> tuple[int, ...]:
    """By set size, the last for that and all larger ones: so many values hold one that a similar set's sketch shares.

    The values both hold of the union's smallest are in both sketches, and so
    many less of a sketch can be in it alone.  The union has from the set's own
    size to 100 / percent times that; draws from one of any size are bounded by
    draws with replacement.
    """
    top = 16 * SKETCH
    shared = [0, *(_shared_at_least(u, percent) for u in range(1, 100 * top // percent + 1))]
    p, miss, endless = percent / 100, 0.0, 0
    while (miss := miss + math.comb(SKETCH, endless) * p**endless * (1 - p) ** (SKETCH - endless)) <= MISS:
        endless += 1
    return (0, *(min(SKETCH, n) + 1 - min(shared[n : 100 * n // percent + 1]) for n in range(1, top)), SKETCH + 1 - endless)


def _if_small(df: DataFrame, broadcast_rows: int) -> DataFrame:
    """df, sent to every executor if it has few rows; a saved frame, so the count reads no column."""
    return F.broadcast(df) if df.count() <= broadcast_rows else df


def _held_by_several(values: DataFrame) -> DataFrame:
    return saved(values.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))


def _key_lists(classes: DataFrame, percent: int, broadcast_rows: int) -> DataFrame:
    """(key, id, n_shingles, late) for the keys of each class; late: how many values of its sketch are frequent."""
    values = classes.select("id", "n_shingles", F.xxhash64("sketch").alias("version"), F.size("sketch").alias("held"), F.explode("sketch").alias("key"))
    common = _held_by_several(values)
    needed = keys_needed(percent)
    first = F.element_at(F.array(*map(F.lit, needed)), (F.least("n_shingles", F.lit(len(needed) - 1)) + 1).cast("int"))
    mine = values.join(_if_small(common, broadcast_rows), "key").groupBy("id", "n_shingles", "version", "held").agg(F.sort_array(F.collect_list(F.struct("n", "key"))).alias("best"), F.sum(F.when(F.col("n") > FREQUENT, 1).otherwise(0)).alias("late"))
    # Values of one sketch alone come first and give no candidate.
    taken = F.slice("best", F.lit(1), F.greatest(first - F.col("held") + F.size("best"), F.lit(0)))
    lists = saved(mine.select(F.explode(taken["key"]).alias("key"), "id", "n_shingles", "late"))
    discard(common)
    return lists


def _prefix_lists(views: DataFrame, percent: int, broadcast_rows: int) -> DataFrame:
    """(key, id, n_all, linked, n, pos, inner) for the rarest elements of each view of a text, as many as can hold the first shared one.

    n elements, this the pos-th by rarity.  inner: among those for a partner
    that is not linked to the pivot, or for one's own being so; the others of a
    text that is not linked are there for partners that are.
    """
    sides, gap = 100 + percent, 100 - percent
    values = views.select("id", "view", "n_all", "n_hub", "linked", F.size("elements").alias("m"), F.xxhash64("elements").alias("version"), F.explode("elements").alias("key"))
    common = _held_by_several(values)
    mine = values.join(_if_small(common, broadcast_rows), "key").groupBy("id", "view", "n_all", "n_hub", "linked", "m", "version").agg(F.sort_array(F.collect_set(F.struct("n", "key"))).alias("best"))
    # Least overlaps: one side differs from the pivot by more than gap / sides of both sizes, for all that it isn't linked to.
    differing = F.floor((sides * F.col("m") + gap * (F.col("n_hub") - F.col("n_all"))) / F.lit(2 * sides)) + 1
    least = F.greatest(F.when(F.col("n_hub") > 0, differing).otherwise(F.ceil(percent * F.col("n_all") / F.lit(100))), F.lit(1))
    to_linked = F.greatest(F.ceil((sides * F.col("m") - gap * (F.col("n_all") + F.col("n_hub"))) / F.lit(2 * sides)), F.lit(1))
    inner = F.col("m") - least + 1
    outer = F.when((F.col("n_hub") > 0) & ~F.col("linked"), F.greatest(F.col("m") - to_linked + 1, inner)).otherwise(inner)
    alone = F.col("m") - F.size("best")
    taken = F.slice("best", F.lit(1), F.greatest((outer - alone).cast("int"), F.lit(0)))
    rows = mine.select("id", "n_all", "linked", F.col("m").alias("n"), alone.alias("alone"), inner.alias("inner"), F.posexplode(taken["key"]).alias("at", "key"))
    lists = saved(rows.select("key", "id", "n_all", "linked", "n", (F.col("at") + F.col("alone")).alias("pos"), (F.col("at") + F.col("alone") < F.col("inner")).alias("inner")))
    discard(common)
    return lists


def _alike(pairs: DataFrame, percent: int) -> DataFrame:
    """Pairs whose set sizes allow the similarity."""
    return pairs.where(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))


def _sides(lists: DataFrame, *columns: str) -> tuple[DataFrame, DataFrame]:
    """Two sides of a join of lists with themselves; each column c becomes c_a and c_b, the ids a and b."""
    named = lambda s: {"id": s, "key": f"key_{s}", **{c: f"{c}_{s}" for c in columns}}
    return lists.withColumnsRenamed(named("a")), lists.withColumnsRenamed(named("b"))


def _short_pairs(lists: DataFrame, percent: int) -> DataFrame:
    """All pairs of lists of bounded length."""
    one, other = _sides(lists.select("key", "id", F.col("n_shingles").alias("n")), "n")
    return _alike(one.join(other, (F.col("key_a") == F.col("key_b")) & (F.col("a") < F.col("b"))), percent).select("a", "b")


def _prefix_pairs(lists: DataFrame, percent: int) -> DataFrame:
    """Pairs of prefix lists that can overlap enough, were this the first element they share."""
    sides, gap = 100 + percent, 100 - percent
    one, other = _sides(lists, "n_all", "linked", "n", "pos", "inner")
    overlap: Column = 2 * sides * F.least(F.col("n_a") - F.col("pos_a"), F.col("n_b") - F.col("pos_b")) >= sides * (F.col("n_a") + F.col("n_b")) - gap * (F.col("n_all_a") + F.col("n_all_b"))
    sizes: Column = 100 * F.least("n_all_a", "n_all_b") >= percent * F.greatest("n_all_a", "n_all_b")
    roles: Column = F.col("inner_a") & ~F.col("linked_b") & F.when(F.col("linked_a"), F.col("a") != F.col("b")).otherwise(F.col("inner_b") & (F.col("a") < F.col("b")))
    return one.join(other, (F.col("key_a") == F.col("key_b")) & roles & sizes & overlap).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


class _Table:
    """Classes with their sketches, and the texts they come from."""

    def __init__(self, classes: DataFrame, texts: DataFrame, size: int, percent: int, broadcast_rows: int):
        self.classes, self.texts, self.size, self.percent, self.broadcast_rows = classes, texts, size, percent, broadcast_rows

    def estimated(self, pairs: DataFrame) -> DataFrame:
        """Distinct pairs (a, b) with their similarity (alike) as the sketches have it."""
        side = lambda c: self.classes.select(F.col("id").alias(c), F.col("sketch").alias(f"sketch_{c}"))
        return saved(pairs.select("a", "b").distinct().join(side("a"), "a").join(side("b"), "b").select("a", "b", "sketch_a", "sketch_b").mapInArrow(_estimated, "a long, b long, alike double"))

    def of(self, ids: DataFrame) -> DataFrame:
        """(id, text) of some ids, a saved frame."""
        return self.texts.join(_if_small(ids, self.broadcast_rows), "id", "left_semi")

    def with_texts(self, pairs: DataFrame) -> DataFrame:
        """(a, b, text_a, text_b)"""
        needed = self.of(saved(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()))
        text = lambda c: needed.select(F.col("id").alias(c), F.col("text").alias(f"text_{c}"))
        return pairs.join(text("a"), "a").join(text("b"), "b").select("a", "b", "text_a", "text_b")

    def confirmed(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) that are linked: estimated from sketches, then confirmed on full sets."""
        guessed = self.estimated(pairs)
        likely = guessed.where(F.col("alike") >= FLOOR).select("a", "b")
        links = saved(self.with_texts(likely).mapInArrow(_verified(self.size, self.percent), "a long, b long"))
        discard(guessed)
        return links

    def recentred(self, lists: DataFrame, pivot_first: Column) -> tuple[DataFrame, DataFrame]:
        """Links of the members of each list to its pivot (the member least by pivot_first), and all members' views."""
        # Saved, so that Spark can split a long list's join.
        pivots = saved(lists.groupBy("key").agg(F.min_by("id", F.struct(pivot_first.alias("p"), F.xxhash64("id").alias("h"), "id")).alias("b")))
        guessed = self.estimated(lists.select("key", F.col("id").alias("a")).join(_if_small(pivots, self.broadcast_rows), "key").where("a <> b"))
        likely = guessed.where(F.col("alike") >= NEAR_FLOOR).select("a", "b")
        stars = saved(self.with_texts(likely).mapInArrow(_centred(self.size, self.percent), f"{_VIEWS}, hub long, far boolean"))
        far = saved(stars.where("far").select("id").unionByName(guessed.where(F.col("alike") < NEAR_FLOOR).select(F.col("a").alias("id"))).distinct())
        own = self.of(far).mapInArrow(_own(self.size), f"{_VIEWS}, hub long, far boolean")
        keep = [c.split()[0] for c in _VIEWS.split(", ")]
        views = saved(stars.where(F.size("elements") > 0).select(*keep).unionByName(own.select(*keep)))
        discard(pivots, guessed, far)
        return stars.where("linked").select(F.col("id").alias("a"), F.col("hub").alias("b")), views


def _by_length(lists: DataFrame, limit: int) -> tuple[DataFrame, DataFrame | None]:
    """Lists of 2 to limit entries, and longer ones (None where there are none)."""
    counts = lists.groupBy("key").agg(F.count(F.lit(1)).alias("entries")).where("entries > 1")
    counted = saved(lists.join(counts, "key"))
    long = counted.where(F.col("entries") > limit).drop("entries")
    return counted.where(F.col("entries") <= limit).drop("entries"), None if long.isEmpty() else long


def _links(table: _Table, percent: int, broadcast_rows: int) -> DataFrame:
    """Links enough to connect all that are linked, between different texts."""
    lists = _key_lists(table.classes, percent, broadcast_rows)
    short, long = _by_length(lists, SHORT)
    discard(lists)
    pairs, pivot_first, links = _short_pairs(short, percent), -F.col("late"), None
    for level in range(1, LEVELS + 1):
        if long is None:
            break
        found, views = table.recentred(long, pivot_first)
        links = found if links is None else links.unionByName(found)
        lists = _prefix_lists(views, percent, broadcast_rows)
        discard(views)
        # In the last round lists of any length are joined: nothing is given up.
        short, long = (lists, None) if level == LEVELS else _by_length(lists, CROWD)
        pairs = pairs.unionByName(_prefix_pairs(short, percent))
        pivot_first = F.col("n")
    found = table.confirmed(pairs)
    return found if links is None else links.unionByName(found)


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", size: int = 4, percent: int = 80, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """(key, n_shingles, component_id, kept) for every row of df.

    Rows are linked where the sets of word shingles (size words; a shorter text
    is one shingle) have 100 * intersection >= percent * union; component_id is
    the smallest key reachable and kept says that it is the row's own.  Null,
    empty and wordless texts have no shingles and no link.  Rows that repeat a
    key are versions of one document: its links are those of all of them.  A
    row with a null key is linked with nothing: its component is null and it is
    kept.  Texts of any length are read whole.  Other columns don't matter; an
    empty table gives an empty one.
    """
    rows = df.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{text}`").cast("string").alias("text"))
    sketches = saved(small_batches(rows).mapInArrow(_sketch(size), _SKETCHES))
    live = sketches.where("n_shingles > 0 and id is not null")
    first = saved(live.groupBy("d1", "d2").agg(F.min("id").alias("rep")))
    member = live.join(first, ["d1", "d2"])
    # A repeated key may stand for several classes; pairs are confirmed text by text.
    classes = saved(member.where("id = rep").select("id", "n_shingles", "sketch").dropDuplicates(["id", "n_shingles", "sketch"]))
    members = saved(member.select("id", "n_shingles", "rep").unionByName(sketches.where("n_shingles = 0 or id is null").select("id", "n_shingles", F.lit(None).cast("long").alias("rep"))))
    repeated = saved(live.groupBy("id").agg(F.min("d1").alias("low"), F.max("d1").alias("high")).where("low < high").select("id"))
    discard(sketches, first)
    links = _links(_Table(classes, rows, size, percent, broadcast_rows), percent, broadcast_rows)
    if not repeated.isEmpty():
        # What a key's rows are in is linked: the representatives of its classes, through the key.
        links = links.unionByName(members.where("id <> rep").select(F.col("rep").alias("a"), F.col("id").alias("b")).join(repeated, F.col("b") == F.col("id"), "left_semi"))
    every = components(links)
    discard(classes, repeated)
    linked = members.where("rep is not null").join(every.withColumnRenamed("node", "rep"), "rep", "left").select("id", "n_shingles", F.coalesce("component", "rep").alias("component_id"))
    out = linked.unionByName(members.where("rep is null").select("id", "n_shingles", F.col("id").alias("component_id")))
    return out.select(F.col("id").alias(key), "n_shingles", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))


def oracle_sql(table: str = "documents", key: str = "doc_id", size: int = 4, percent: int = 80) -> str:
    """The same links and components as DuckDB SQL, every pair that shares a shingle compared."""
    return f"""
WITH RECURSIVE texts AS (
  SELECT {key} AS id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM {table}),
sets AS (
  SELECT id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {size} THEN [array_to_string(w, ' ')]
    ELSE list_distinct([array_to_string(w[i:i + {size - 1}], ' ') FOR i IN range(1, len(w) - {size - 2})]) END AS s FROM texts),
shingles AS (SELECT id, len(s) AS n, unnest(s) AS x FROM sets),
links AS (
  SELECT a.id AS a, b.id AS b FROM shingles a JOIN shingles b ON a.x = b.x AND a.id < b.id
  GROUP BY a.id, b.id, a.n, b.n HAVING 100 * count(*) >= {percent} * (a.n + b.n - count(*))),
both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT id AS a, id AS b FROM sets UNION SELECT r.a, l.b FROM reach r JOIN both_ways l ON l.a = r.b),
smallest AS (SELECT a AS id, min(b) AS component_id FROM reach GROUP BY a)
SELECT id AS {key}, CAST(len(s) AS BIGINT) AS n_shingles, component_id, id = component_id AS kept FROM sets JOIN smallest USING (id)"""
