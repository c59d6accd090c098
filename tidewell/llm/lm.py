"""Language-model scoring with an Elias-Fano bigram trie.

The documents are cut into batches of tokens, kept as a table.  Words are
counted in shards by hash range, which also number them; bigrams are counted in
shards by context, frequent contexts in several.  Each bigram shard becomes a
compact trie (:mod:`elias_fano`) of quantised smoothed probabilities; its image
is kept with the answers in the shared folder, and is memory-mapped for the
batches' look-ups.  The model interpolates with a Dirichlet prior:

    P(w | c) = n(c, w) / (n(c) + MU) + MU / (n(c) + MU) * P(w)

of which the trie holds the first term; P(w) is the smoothed unigram
probability, with all unseen words as one.  Shards grow in number, not in size,
with the corpus; nothing the corpus gathers goes through the driver but two
sums and the number of words of each shard.
"""

from __future__ import annotations

import tempfile
import uuid
from typing import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .elias_fano import NgramTrie, dequantise
from .textcore import mix64, saved, slices, small_batches, words_of

MU = 200.0
BATCH_CHARS = 8 << 20
#: Entries that a shard gets on average.
WORDS_PER_SHARD = 1_000_000
BIGRAMS_PER_SHARD = 2_000_000
#: A context seen more often is cut over several shards, by its words.
CONTEXT_PER_SHARD = 1 << 16
#: The token that ends each text, and the context of its first token.
END = np.uint64(0xFFFFFFFFFFFFFFFF)


def pack(values: np.ndarray) -> bytes:
    """Integers, byte plane by byte plane, compressed."""
    values = np.ascontiguousarray(values)
    planes = values.view(np.uint8).reshape(len(values), -1).T if len(values) else np.zeros((1, 0), np.uint8)
    return values.dtype.str.encode().ljust(4) + zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def unpack(data: bytes) -> np.ndarray:
    """What pack() was given."""
    kind = np.dtype(data[:4].decode().strip())
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[4:]), np.uint8)
    return np.ascontiguousarray(raw.reshape(kind.itemsize, -1).T).view(kind).ravel()


_BATCHES = "batch long, docs binary, role binary, lengths binary, words binary, tokens binary, n_train long, n_train_docs long, n_tokens long, n_words long"


def _to_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tokens as places in the sorted distinct word hashes of the batch; role: 1 training, 2 held out, +4 null id."""
    names = [x.split()[0] for x in _BATCHES.split(", ")]
    for whole in batches:
        for batch in slices(whole, "text", BATCH_CHARS):
            words = words_of(batch.column("text"))
            n = len(words.first) - 1
            held = batch.column("held")
            ids = batch.column("id")
            absent = np.asarray(ids.is_null())
            role = np.where(np.asarray(held.fill_null(False)), 2, np.where(absent, 0, 1)) + 4 * absent
            lengths = np.diff(words.first) + 1
            hashes = np.full(len(words.hashes) + n, END, dtype=np.uint64)
            hashes[np.arange(len(words.hashes)) + np.repeat(np.arange(n), np.diff(words.first))] = words.hashes
            known, tokens = np.unique(hashes, return_inverse=True)
            train = role == 1
            yield pa.RecordBatch.from_arrays(
                [pa.array([x]) for x in (uuid.uuid4().int >> 65, pack(np.asarray(ids.fill_null(0)).astype(np.int64)), role.astype(np.uint8).tobytes(), pack(lengths.astype(np.int64)), pack(known), pack(tokens.astype(np.int32)), int(lengths[train].sum()), int(train.sum()), len(hashes), len(known))],
                names,
            )


def _ranges(n: int) -> np.ndarray:
    """The first hash of each of n equal ranges but the first one."""
    return np.array([(k << 64) // n for k in range(1, n)], dtype=np.uint64)


def _word_counts(shards: int):
    """Each batch's distinct words and their training counts, by shard."""

    def run(batches):
        for table in batches:
            out = []
            for r in table.to_pylist():
                known, tokens, lengths = unpack(r["words"]), unpack(r["tokens"]), unpack(r["lengths"])
                train = np.repeat(np.frombuffer(r["role"], np.uint8) == 1, lengths)
                counts = np.bincount(tokens[train], minlength=len(known))
                ends = [0, *np.searchsorted(known, _ranges(shards)).tolist(), len(known)]
                out += [(k, r["batch"], pack(known[a:b]), pack(counts[a:b].astype(np.int32))) for k, (a, b) in enumerate(zip(ends, ends[1:])) if b > a]
            yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in out], t) for c, t in enumerate((pa.int32(), pa.int64(), pa.binary(), pa.binary()))], ["shard", "batch", "a", "b"])

    return run


def _merged(parts: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct values, their summed counts, and the place of each given value among them."""
    every, place = np.unique(np.concatenate(parts), return_inverse=True)
    return every, np.bincount(place, weights=np.concatenate(counts), minlength=len(every)).astype(np.int64), place


def _number_words(group: pa.Table) -> pa.Table:
    """For each batch's slice the words' numbers in the shard (-1: not in training) and counts; in one row without batch, how many there are."""
    rows = group.to_pylist()
    parts = [unpack(r["a"]) for r in rows]
    _, counts, place = _merged(parts, [unpack(r["b"]) for r in rows])
    number = np.where(counts > 0, np.cumsum(counts > 0) - 1, -1)
    ends = np.cumsum([0, *map(len, parts)])
    out = [(r["batch"], r["shard"], pack(number[place[a:b]].astype(np.int32)), pack(counts[place[a:b]].astype(np.int64)), 0) for r, a, b in zip(rows, ends, ends[1:])]
    out.append((None, rows[0]["shard"], b"", b"", int((counts > 0).sum())))
    return pa.table([pa.array([x[c] for x in out], t) for c, t in enumerate((pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.int64()))], names=["batch", "shard", "a", "b", "n"])


_REPLIES = "batch long, shard int, a binary, b binary, n long"


class _Numbered:
    """A batch with its words' numbers and counts."""

    def __init__(self, row: dict, replies: list[dict], offsets: list[int]):
        replies = sorted(replies, key=lambda r: r["shard"])
        numbers = [unpack(r["a"]).astype(np.int64) for r in replies]
        number = np.concatenate([np.where(x >= 0, x + offsets[r["shard"]], -1) for r, x in zip(replies, numbers)])
        count = np.concatenate([unpack(r["b"]) for r in replies])
        tokens = unpack(row["tokens"])
        self.lengths = unpack(row["lengths"])
        self.docs, self.role = unpack(row["docs"]), np.frombuffer(row["role"], np.uint8)
        self.first = np.cumsum(self.lengths) - self.lengths
        self.word, self.count = number[tokens], count[tokens]

    def contexts(self, n_train_docs: int) -> tuple[np.ndarray, np.ndarray]:
        """The context of each token, by the words' numbers plus 1 (0 begins a text), and its training count."""
        context, count = np.empty_like(self.word), np.empty_like(self.count)
        context[1:], count[1:] = self.word[:-1] + 1, self.count[:-1]
        context[self.first], count[self.first] = 0, n_train_docs
        context[(context == 0) & ~self._begins()] = -1
        return context, count

    def _begins(self) -> np.ndarray:
        out = np.zeros(len(self.word), bool)
        out[self.first] = True
        return out

    def bigrams(self, context: np.ndarray, context_count: np.ndarray, shards: int):
        """Distinct (shard, context, word) in order, their training counts, their contexts' counts, and the place of each token (-1: word or context not in training)."""
        good = np.flatnonzero((context >= 0) & (self.word >= 0))
        c, w = context[good], self.word[good]
        parts = (context_count[good] // CONTEXT_PER_SHARD + 1).astype(np.int64)
        shard = (mix64((c * 1_000_003 + w % parts).astype(np.uint64)) % np.uint64(shards)).astype(np.int64)
        code, place = np.unique((c.astype(np.uint64) << np.uint64(32)) | w.astype(np.uint64), return_inverse=True)
        sample = np.empty(len(code), np.int64)
        sample[place] = good
        where = np.empty(len(code), np.int64)
        where[place] = shard
        order = np.argsort(where, kind="stable")
        back = np.empty(len(code), np.int64)
        back[order] = np.arange(len(code))
        train = np.repeat(self.role == 1, self.lengths)[good]
        counts = np.bincount(place[train], minlength=len(code))
        where, code, sample, counts = where[order], code[order], sample[order], counts[order]
        at = np.full(len(self.word), -1, np.int64)
        at[good] = back[place]
        return where, code, counts, context_count[sample], at


def _checked(words: int) -> None:
    if words >= 1 << 32:
        raise ValueError("more than 2 ** 32 distinct words")


def _bigram_counts(offsets: list[int], n_train_docs: int, shards: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        replies = right.to_pylist()
        for row in left.to_pylist():
            batch = _Numbered(row, replies, offsets)
            context, context_count = batch.contexts(n_train_docs)
            where, code, counts, of_context, _ = batch.bigrams(context, context_count, shards)
            ends = np.searchsorted(where, np.arange(shards + 1))
            for k, (a, b) in enumerate(zip(ends, ends[1:])):
                if b > a:
                    c = (code[a:b] >> np.uint64(32)).astype(np.int64)
                    new = np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1]]))
                    runs = np.diff(np.concatenate([new, [b - a]]))
                    out.append((k, row["batch"], pack(np.diff(c[new], prepend=0).astype(np.uint32)), pack(runs.astype(np.int32)), pack(of_context[a:b][new]), pack((code[a:b] & np.uint64(0xFFFFFFFF)).astype(np.uint32)), pack(counts[a:b].astype(np.int32))))
        return pa.table([pa.array([x[c] for x in out], t) for c, t in enumerate((pa.int32(), pa.int64(), *[pa.binary()] * 5))], names=["shard", "batch", "contexts", "runs", "of_context", "words", "counts"])

    return run


def build_trie(code: np.ndarray, counts: np.ndarray, of_context: np.ndarray, mu: float = MU) -> NgramTrie:
    """A trie of the bigrams (context << 32 | word, in order) that were counted."""
    seen = counts > 0
    code = code[seen]
    return NgramTrie.build((code >> np.uint64(32)).astype(np.int64), (code & np.uint64(0xFFFFFFFF)).astype(np.int64), counts[seen] / (of_context[seen] + mu))


def mapped(image: bytes) -> NgramTrie:
    """A trie over a memory-mapped file of its image; the file has no name and goes with the trie."""
    with tempfile.TemporaryFile() as file:
        file.write(image)
        file.flush()
        return NgramTrie.open(file)


def _answers(mu: float):
    """The codes of each batch's bigrams, from the trie of their shard; in one row without batch, the trie's image."""

    def run(group: pa.Table) -> pa.Table:
        rows = group.to_pylist()
        codes, counts, of_context = [], [], []
        for r in rows:
            runs = unpack(r["runs"])
            context = np.repeat(np.cumsum(unpack(r["contexts"]).astype(np.uint64)), runs)
            codes.append((context << np.uint64(32)) | unpack(r["words"]).astype(np.uint64))
            counts.append(unpack(r["counts"]))
            of_context.append(np.repeat(unpack(r["of_context"]), runs))
        ends = np.cumsum([0, *map(len, codes)])
        every, total, place = _merged(codes, counts)
        context_count = np.empty(len(every), np.int64)
        context_count[place] = np.concatenate(of_context)
        image = build_trie(every, total, context_count, mu).to_bytes()
        del codes[:], counts[:], of_context[:], total, context_count
        found = mapped(image).codes_of((every >> np.uint64(32)).astype(np.int64), (every & np.uint64(0xFFFFFFFF)).astype(np.int64))
        out = [(r["batch"], r["shard"], b"", pack(found[place[a:b]]), -1) for r, a, b in zip(rows, ends, ends[1:])]
        out.append((None, rows[0]["shard"], image, b"", -1))
        return pa.table([pa.array([x[c] for x in out], t) for c, t in enumerate((pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.int64()))], names=["batch", "shard", "a", "b", "n"])

    return run


_SCORES = "held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _scores(offsets: list[int], total: int, n_train_docs: int, shards: int, mu: float, key: str):
    distinct = offsets[-1]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        replies = right.to_pylist()
        parts = []
        for row in left.to_pylist():
            batch = _Numbered(row, [r for r in replies if r["n"] != -1], offsets)
            context, context_count = batch.contexts(n_train_docs)
            *_, at = batch.bigrams(context, context_count, shards)
            answers = sorted((r for r in replies if r["n"] == -1), key=lambda r: r["shard"])
            codes = np.concatenate([np.zeros(0, np.uint16), *(unpack(r["b"]) for r in answers)])
            seen = np.zeros(len(at))
            seen[at >= 0] = dequantise(codes)[at[at >= 0]]
            base = (batch.count + 0.1) / (total + 0.1 * (distinct + 1))
            model = seen + mu / (np.where(context >= 0, context_count, 0) + mu) * base
            add = lambda x: np.add.reduceat(x, batch.first) if len(batch.first) else np.zeros(0)
            absent = (batch.role & 4) > 0
            parts.append(pa.table(
                [pa.array(batch.docs, mask=absent), pa.array((batch.role & 2) > 0), pa.array(batch.lengths), pa.array(add((batch.count > 0).astype(np.int64))), pa.array(np.full(len(absent), total, np.int64)), pa.array(add(np.log10(base))), pa.array(add(np.log10(model)))],
                names=[key, *(x.split()[0] for x in _SCORES.split(", "))],
            ))
        return pa.concat_tables(parts) if parts else pa.table({key: pa.array([], pa.int64()), "held_out": pa.array([], pa.bool_()), **{c: pa.array([], pa.int64()) for c in ("n_tokens", "n_known", "train_tokens")}, **{c: pa.array([], pa.float64()) for c in ("base_score", "score")}})

    return run


def score_texts(df: DataFrame, key: str = "doc_id", text: str = "text", held_out: int = 10, mu: float = MU) -> DataFrame:
    """(key, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row of df.

    Rows whose crc32(key as text) mod held_out is 0 are held out, the others
    are learned from; a row with a null key is scored but not learned from.
    Tokens are the words of :mod:`textcore` and one end for each text, so a null
    or empty text has one token.  Scores are log10: of the unigram base (each
    token's training count plus 0.1) and of the bigram model.  Repeated rows
    count and are scored each; texts of any length are read whole; an empty
    table gives an empty one; without a training row every token is unseen.
    """
    rows = df.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{text}`").cast("string").alias("text"), (F.crc32(F.col(f"`{key}`").cast("string")) % held_out == 0).alias("held"))
    batches = saved(small_batches(rows).mapInArrow(_to_batches, _BATCHES))
    sums = batches.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n_train", "n_train_docs", "n_tokens", "n_words")]).first()
    word_shards, shards = -(-sums["n_words"] // WORDS_PER_SHARD) or 1, -(-sums["n_tokens"] // BIGRAMS_PER_SHARD) or 1
    slices_ = batches.select("batch", "role", "lengths", "words", "tokens").mapInArrow(_word_counts(word_shards), "shard int, batch long, a binary, b binary")
    replies = saved(slices_.groupBy("shard").applyInArrow(_number_words, _REPLIES))
    offsets = [0] * (word_shards + 1)
    for r in replies.where("batch is null").select("shard", "n").collect():
        offsets[r["shard"] + 1] = r["n"]
    offsets = np.cumsum(offsets).tolist()
    _checked(offsets[-1] + 1)
    tokens = batches.select("batch", "docs", "role", "lengths", "tokens")
    numbered = replies.where("batch is not null")
    counted = tokens.groupBy("batch").cogroup(numbered.groupBy("batch")).applyInArrow(_bigram_counts(offsets, sums["n_train_docs"], shards), "shard int, batch long, contexts binary, runs binary, of_context binary, words binary, counts binary")
    answers = saved(counted.groupBy("shard").applyInArrow(_answers(mu), _REPLIES)).where("batch is not null")
    return tokens.groupBy("batch").cogroup(numbered.unionByName(answers).groupBy("batch")).applyInArrow(_scores(offsets, sums["n_train"], sums["n_train_docs"], shards, mu, key), f"`{key}` long, {_SCORES}")
