"""Benchmark decontamination by SimHash of item-sized windows.

Every benchmark item has a 64-bit SimHash of its word shingles.  In a document,
the windows of as many words as an item has are fingerprinted in the same way;
fingerprints are looked up in a multi-index: eight blocks of eight bits, each
filed under all values within RADIUS // 8 bits, so that no fingerprint within
RADIUS bits of an item's is missed.  What the multi-index gives is verified by
the exact weighted similarity: the sum of the smaller over the sum of the
larger counts of each shingle.

A window without any shingle of an item has similarity 0 to all, so only
windows that hold one are fingerprinted; that leaves out no match.  Two shingle
multisets of similarity 0.8 differ in 9.7 of 64 bits on average (standard
deviation 2.9), so RADIUS is passed with a probability of about 1e-6.
"""

from __future__ import annotations

from collections import defaultdict
from itertools import combinations
from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textcore import mix64, shingle_hashes, slices, small_batches, whole_hash, words_of

BLOCKS = 8
RADIUS = 23
#: Items are sent to the executors in blocks of at most about so many characters.
BLOCK_CHARS = 4_000_000
_GATE_BITS = 22


def simhash(shingles: np.ndarray) -> np.uint64:
    """Each bit is the majority of that bit of all shingle hashes, occurrences counted; ties are 0."""
    bits = np.unpackbits(shingles.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.packbits(2 * bits.sum(axis=0, dtype=np.int64) > len(shingles), bitorder="little").view("<u8")[0]


def _item_shingles(hashes: np.ndarray, size: int) -> np.ndarray:
    return shingle_hashes(hashes, size) if len(hashes) >= size else whole_hash(hashes)


class ItemIndex:
    """Items by shingle and, for each length in words, by blocks of their fingerprints."""

    def __init__(self, ids: list[int], texts: list[str | None], size: int):
        self.size = size
        words = words_of(pa.array(texts, type=pa.string()))
        spans = [words.hashes[a:b] for a, b in zip(words.first[:-1], words.first[1:])]
        live = [k for k, s in enumerate(spans) if len(s)]
        self.ids = np.array([ids[k] for k in live], dtype=np.int64)
        self.length = np.array([len(spans[k]) for k in live], dtype=np.int64)
        self.shingles = [_item_shingles(spans[k], size) for k in live]
        self.counts = [dict(zip(*(x.tolist() for x in np.unique(s, return_counts=True)))) for s in self.shingles]
        self.prints = np.array([simhash(s) for s in self.shingles], dtype=np.uint64)
        by_shingle: dict[int, set[int]] = defaultdict(set)
        for length, found in zip(self.length.tolist(), self.shingles):
            for x in found.tolist():
                by_shingle[x].add(length)
        self.known = np.array(sorted(by_shingle), dtype=np.uint64)
        self.lengths_of = [sorted(by_shingle[int(x)]) for x in self.known]
        self.gate = np.zeros(1 << _GATE_BITS, dtype=bool)
        self.gate[self.known >> np.uint64(64 - _GATE_BITS)] = True
        self.short = sorted({int(n) for n in self.length if n < size})
        near = [sum(1 << b for b in flips) for n in range(RADIUS // BLOCKS + 1) for flips in combinations(range(64 // BLOCKS), n)]
        self.tables: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        for length in sorted(set(self.length.tolist())):
            items = np.flatnonzero(self.length == length)
            self.tables[length] = []
            for block in range(BLOCKS):
                value = (self.prints[items] >> np.uint64(8 * block)).astype(np.int64) & 255
                filed = (value[:, None] ^ np.array(near)[None, :]).ravel()
                owner = np.repeat(items, len(near))
                order = np.argsort(filed, kind="stable")
                self.tables[length].append((np.searchsorted(filed[order], np.arange(257)), owner[order]))

    def within(self, length: int, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All (fingerprint, item) of this length within RADIUS bits, as two index arrays."""
        pairs = []
        for block, (start, owner) in enumerate(self.tables[length]):
            value = (prints >> np.uint64(8 * block)).astype(np.int64) & 255
            low, n = start[value], start[value + 1] - start[value]
            who = np.repeat(np.arange(len(prints)), n)
            at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)
            pairs.append(who * len(self.ids) + owner[at])
        code = np.unique(np.concatenate(pairs))
        who, item = code // len(self.ids), code % len(self.ids)
        close = np.bitwise_count(prints[who] ^ self.prints[item]) <= RADIUS
        return who[close], item[close]

    def similarity(self, item: int, window: np.ndarray) -> float:
        """Sum of smaller over sum of larger counts."""
        mine = self.counts[item]
        shared = 0
        seen: dict[int, int] = {}
        for x in window.tolist():
            if x in mine:
                seen[x] = seen.get(x, 0) + 1
        for x, n in seen.items():
            shared += min(n, mine[x])
        return shared / (len(window) + len(self.shingles[item]) - shared)

    def matches(self, column: pa.Array, least: float) -> Iterator[tuple[int, int, float, int, int]]:
        """(text, item, similarity, first word, words) of the best window for each text and item."""
        words = words_of(column)
        if not len(words.hashes) or not len(self.ids):
            return
        size, total = self.size, len(words.hashes)
        every = shingle_hashes(words.hashes, size)
        windows: set[tuple[int, int, int]] = set()

        def add(hits: np.ndarray, hashes: np.ndarray, span: int) -> None:
            doc = np.searchsorted(words.first, hits, side="right") - 1
            inside = hits + span <= words.first[doc + 1]
            at = np.minimum(np.searchsorted(self.known, hashes), len(self.known) - 1)
            good = inside & (self.known[at] == hashes)
            for p, d, k in zip(hits[good].tolist(), doc[good].tolist(), at[good].tolist()):
                low, high = int(words.first[d]), int(words.first[d + 1])
                for length in self.lengths_of[k]:
                    n = min(length, high - low)
                    windows.update((length, d, s) for s in range(max(low, p + span - n), min(p, high - n) + 1))

        if len(every):
            hits = np.flatnonzero(self.gate[every >> np.uint64(64 - _GATE_BITS)])
            add(hits, every[hits], size)
        for n in self.short:
            if total >= n:
                whole = _runs(words.hashes, n)
                hits = np.flatnonzero(self.gate[whole >> np.uint64(64 - _GATE_BITS)])
                add(hits, whole[hits], n)
        # A text shorter than the shingle size is one shingle, as items are.
        by_length: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for length, d, s in windows:
            by_length[length].append((d, s))
        best: dict[tuple[int, int], tuple[float, int, int]] = {}
        for length, found in by_length.items():
            found.sort()
            docs = np.array([d for d, _ in found])
            start = np.array([s for _, s in found])
            n = np.minimum(length, words.first[docs + 1] - words.first[docs])
            prints = self._prints(words.hashes, every, start, n)
            who, item = self.within(length, prints)
            for w, i in zip(who.tolist(), item.tolist()):
                d, s, m = int(docs[w]), int(start[w]), int(n[w])
                window = every[s : s + m - size + 1] if m >= size else whole_hash(words.hashes[s : s + m])
                alike = self.similarity(i, window)
                if alike >= least and ((d, i) not in best or (-best[d, i][0], best[d, i][1]) > (-alike, s)):
                    best[d, i] = (alike, s, m)
        for (d, i), (alike, s, m) in sorted(best.items()):
            yield d, i, alike, s - int(words.first[d]), m

    def _prints(self, hashes: np.ndarray, every: np.ndarray, start: np.ndarray, n: np.ndarray) -> np.ndarray:
        """SimHash of each window, from running sums over the stretches that windows cover."""
        out = np.zeros(len(start), dtype=np.uint64)
        full = n >= self.size
        for k in np.flatnonzero(~full).tolist():
            out[k] = simhash(whole_hash(hashes[start[k] : start[k] + n[k]]))
        low, high = start[full], start[full] + n[full] - self.size + 1
        if not len(low):
            return out
        result = np.empty(len(low), dtype=np.uint64)
        at = 0
        while at < len(low):  # windows are in order; a stretch of them at a time bounds the sums
            stop = max(at + 1, int(np.searchsorted(low, low[at] + 50_000)))
            a, b = int(low[at]), int(high[at:stop].max())
            bits = np.unpackbits(every[a:b].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            sums = np.zeros((b - a + 1, 64), dtype=np.int32)
            np.cumsum(bits, axis=0, out=sums[1:])
            major = 2 * (sums[high[at:stop] - a] - sums[low[at:stop] - a]) > (high[at:stop] - low[at:stop])[:, None]
            result[at:stop] = np.packbits(major, axis=1, bitorder="little").view("<u8").ravel()
            at = stop
        out[full] = result
        return out


def _runs(hashes: np.ndarray, n: int) -> np.ndarray:
    """whole_hash of each run of n words."""
    return mix64(shingle_hashes(hashes, n) + np.uint64(n))


def find_leaks(
    docs: DataFrame,
    items: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    item_key: str = "item_id",
    item_text: str = "text",
    size: int = 5,
    least: float = 0.8,
    block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """(key, item_key, similarity, first_word, n_words) for each document and item it holds.

    A document holds an item if a window of as many words (the whole document,
    if it has fewer) has a weighted shingle similarity of least or more; the
    most similar, then the first, such window is given.  Words are those of
    :mod:`textcore`; an item of fewer than size words is one shingle.  Null,
    empty and wordless texts and items match nothing; repeated documents and
    items each give their own rows; empty tables give an empty result.

    Items go to the executors in blocks of about block_chars characters, each
    block a pass over the documents, so that no more than that is broadcast.
    """
    rows = small_batches(docs).select(F.col(f"`{key}`").cast("long").alias("key"), F.col(f"`{text}`").cast("string").alias("text"))
    schema = f"`{key}` long, `{item_key}` long, similarity double, first_word long, n_words long"
    out = None
    for index in _indexes(items, item_key, item_text, size, block_chars):
        found = rows.mapInArrow(_scan(index, least, [key, item_key]), schema)
        out = found if out is None else out.unionByName(found)
    return out


def _indexes(items: DataFrame, item_key: str, item_text: str, size: int, block_chars: int) -> Iterator[ItemIndex]:
    """The items in blocks of about block_chars characters, one at least."""
    wanted = items.select(F.col(f"`{item_key}`").cast("long").alias("id"), F.coalesce(F.col(f"`{item_text}`").cast("string"), F.lit("")).alias("t"))
    chars = wanted.agg(F.sum(F.char_length("t")).alias("n")).first()["n"] or 0
    blocks = -(-chars // block_chars) or 1
    wanted = wanted.withColumn("block", F.pmod(F.xxhash64("id", "t"), F.lit(blocks)))
    for block in range(blocks):
        listed = wanted.where(F.col("block") == block).orderBy("id", "t").collect()
        yield ItemIndex([r["id"] for r in listed], [r["t"] for r in listed], size)


def _scan(index: ItemIndex, least: float, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", 2 << 20):
                found = list(index.matches(batch.column("text"), least))
                if not found:
                    continue
                doc, item, alike, first, n = (list(x) for x in zip(*found))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("key").take(pa.array(doc)), pa.array(index.ids[item]), pa.array(alike, pa.float64()), pa.array(first, pa.int64()), pa.array(n, pa.int64())],
                    [*names, "similarity", "first_word", "n_words"],
                )

    return run


def _unleaked(index: ItemIndex, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "__leak_text", 2 << 20):
                keep = np.ones(batch.num_rows, bool)
                keep[[m[0] for m in index.matches(batch.column("__leak_text"), least)]] = False
                yield batch.filter(pa.array(keep))

    return run


def clean(docs: DataFrame, items: DataFrame, text: str = "text", item_key: str = "item_id", item_text: str = "text", size: int = 5, least: float = 0.8, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows of docs that hold no item, as they are.

    Each row is judged by its own text, whatever its key (null, or one that
    other rows have too); null, empty and wordless texts hold nothing and stay;
    texts of any length are read whole.  All blocks of items are met in one
    pass over docs, without a shuffle.
    """
    out = small_batches(docs).withColumn("__leak_text", F.col(f"`{text}`").cast("string"))
    for index in _indexes(items, item_key, item_text, size, block_chars):
        out = out.mapInArrow(_unleaked(index, least), out.schema)
    return out.drop("__leak_text")
