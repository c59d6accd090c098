"""Quality classifier by compression.

Two zstandard dictionaries are built, one from good and one from bad labelled
texts.  A text is compressed whole with each, in blocks of BLOCK bytes that the
dictionary is at hand for, so that a long text is judged by the dictionaries
and not by its own repetitions.  The difference of the two sizes, normalised by
the block's size, is the only signal; a block counts for the good side by CAP at
most, so that a few familiar lines don't outweigh the rest.  A monotone fit on
labelled texts that the dictionaries have not seen makes the mean difference a
probability, which never falls as the difference rises.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textcore import slices, small_batches, text_buffer

LEVEL = 3
BLOCK = 256
CAP = 0.05
PRIOR_BYTES = 64


def monotone_fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the non-decreasing step fit of y (0 or 1) by x: neighbours out of order are pooled.

    A pool has its height from its first to its last x, with half an observation
    of each label added, so that the ends stay off 0 and 1.  A hundredth
    of the height is the place in the whole range: within a pool too, a larger
    x is a little higher.
    """
    values, place = np.unique(x, return_inverse=True)
    each = np.bincount(place, weights=weight), np.bincount(place, weights=weight * y)
    pools: list[list[float]] = []  # weight, weighted y, first x, last x
    for value, w, wy in zip(values, *each):
        pools.append([w, wy, value, value])
        while len(pools) > 1 and pools[-2][1] * pools[-1][0] >= pools[-1][1] * pools[-2][0]:
            w, wy, _, last = pools.pop()
            pools[-1] = [pools[-1][0] + w, pools[-1][1] + wy, pools[-1][2], last]
    w, wy, first, last = np.array(pools).T
    knots = np.column_stack([first, last]).ravel()
    heights = np.repeat(np.maximum.accumulate((wy + 0.5) / (w + 1)), 2)
    return knots, 0.99 * heights + 0.01 * (knots - knots[0]) / max(knots[-1] - knots[0], 1e-12)


@dataclass
class CompressionModel:
    """Dictionaries and calibration (probabilities at some differences); a constant where one class was missing."""

    bad: bytes = b""
    good: bytes = b""
    prior: float = 0.0
    knots: np.ndarray | None = None
    heights: np.ndarray | None = None
    constant: float = 0.5

    def compressors(self) -> list[zstandard.ZstdCompressor]:
        """One for each dictionary, the bad one first."""
        out = []
        for d in (self.bad, self.good):
            dictionary = zstandard.ZstdCompressionDict(d)
            dictionary.precompute_compress(level=LEVEL)
            out.append(zstandard.ZstdCompressor(level=LEVEL, write_content_size=False, write_dict_id=False, dict_data=dictionary))
        return out

    def differences(self, texts: Iterable, compressors=None) -> np.ndarray:
        """Bytes with the bad dictionary less bytes with the good one, by byte of text; the prior for an empty text."""
        bad, good = compressors or self.compressors()
        out = []
        for t in texts:
            blocks = [t[k : k + BLOCK] for k in range(0, len(t), BLOCK)]
            total = sum(min(len(bad.compress(x)) - len(good.compress(x)), CAP * len(x)) for x in blocks)
            out.append((total + PRIOR_BYTES * self.prior) / (len(t) + PRIOR_BYTES))
        return np.array(out, dtype=float)

    def scores(self, texts: Iterable, compressors=None) -> np.ndarray:
        """The probability of label 1 for each text (bytes); an empty one is scored like any other."""
        texts = list(texts)
        if self.knots is None or not texts:
            return np.full(len(texts), self.constant)
        return np.interp(self.differences(texts, compressors), self.knots, self.heights)


def _dictionary(texts: list[bytes], size: int) -> bytes:
    raw = b"".join(texts)
    try:
        return zstandard.train_dictionary(min(size, max(256, len(raw) // 8)), texts).as_bytes()
    except zstandard.ZstdError:  # too little text to choose from: the text itself
        return raw[-size:]


def fit(texts: list[bytes], labels: list[int], folds: int = 3, dictionary_bytes: int = 112 << 10, shares: tuple[float, float] | None = None) -> CompressionModel:
    """A model from labelled texts.

    Each fold is measured with dictionaries of the other folds, so that all
    texts calibrate and none with a dictionary that has seen it; the model's own
    dictionaries are of all texts.  shares are those of labels 0 and 1 where the
    texts come from, if others than among the texts.  With too few texts of a
    class (fewer than 8) the score is the share of label 1, or 0.5 without
    labels.
    """
    y = np.array(labels, dtype=float)
    groups = {q: [t for t, label in zip(texts, labels) if label == q] for q in (0, 1)}
    if min(map(len, groups.values())) < 8:
        return CompressionModel(constant=float(y.mean()) if len(y) else 0.5)
    ordered = groups[0] + groups[1]
    target = np.array([0.0] * len(groups[0]) + [1.0] * len(groups[1]))
    fold = np.array([k % folds for q in (0, 1) for k in range(len(groups[q]))])
    trained = lambda keep: [_dictionary([t for t, y, k in zip(ordered, target, keep) if k and y == q], dictionary_bytes) for q in (0, 1)]
    # With a prior of 0 a difference is the sum over the lengthened text.
    length, summed = np.array([len(t) for t in ordered]), np.zeros(len(ordered))
    for f in range(folds):
        own = np.flatnonzero(fold == f)
        summed[own] = CompressionModel(*trained(fold != f)).differences([ordered[k] for k in own]) * (length[own] + PRIOR_BYTES)
    part = {q: shares[q] if shares else len(groups[q]) for q in (0, 1)}
    weight = np.array([part[q] / sum(part.values()) * len(target) / len(groups[q]) for q in (0, 1) for _ in groups[q]])
    prior = float((weight * summed).sum() / max(1.0, (weight * length).sum()))
    knots, heights = monotone_fit((summed + PRIOR_BYTES * prior) / (length + PRIOR_BYTES), target, weight)
    return CompressionModel(*trained(fold >= 0), prior, knots, heights)


def fit_labelled(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "quality", rows_per_class: int = 2000, longest: int = 1 << 16) -> CompressionModel:
    """Fits on a bounded sample of labelled rows, spread evenly by a hash of the key.

    At most rows_per_class rows of each label come to the driver, chosen among
    those with a text of up to longest characters; the calibration weighs them
    by the shares of the two labels in the whole table.  Rows with a
    null key, label or text are not learned from.
    """
    marked = labels.select(F.col(key).alias("_key"), F.col(label).cast("int").alias("_label")).where("_key is not null and _label in (0, 1)")
    known = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")).where(F.char_length("_text") <= longest)
    counts = {r["_label"]: r["n"] for r in marked.groupBy("_label").agg(F.count(F.lit(1)).alias("n")).collect()}
    order = F.xxhash64(F.col("_key").cast("string"), F.lit(17))
    # Keys of usable rows first, so that texts travel for the chosen ones alone.
    usable = known.select("_key").join(marked, "_key")
    sample: list = []
    for q in (0, 1):
        chosen = usable.where(F.col("_label") == q).distinct().orderBy(order, "_key").limit(rows_per_class)
        found = known.join(F.broadcast(chosen), "_key").select(F.col("_text").cast("binary").alias("t"), "_label", order.alias("o"), "_key")
        sample += found.orderBy("o", "_key", "t").limit(rows_per_class).collect()
    shares = (counts[0], counts[1]) if counts.get(0) and counts.get(1) else None
    return fit([bytes(r["t"]) for r in sample], [r["_label"] for r in sample], shares=shares)


def score_texts(df: DataFrame, model: CompressionModel, text: str = "text", keep_text: bool = True, cut: float = 0.3) -> DataFrame:
    """Adds score (double, 0 to 1) and predicted (int, 1 from cut up); columns of these names are replaced.

    A null text is scored like an empty one.  Rows are scored alone and kept,
    repeated ones too; an empty table gives an empty one; texts of any length
    are compressed whole.  Only the text decides.
    """
    names = [c for c in df.columns if c.lower() not in ("score", "predicted") and (keep_text or c.lower() != text.lower())]
    wide = df.select(*[F.col(f"`{c}`") for c in names], F.col(f"`{text}`").alias("__q_text"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressors = model.compressors()
        for whole in batches:
            for batch in slices(whole, "__q_text", 8 << 20):
                data, offsets = text_buffer(batch.column("__q_text"))
                view = memoryview(np.ascontiguousarray(data))
                scores = model.scores((view[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())), compressors)
                yield pa.RecordBatch.from_arrays([batch.column(c) for c in names] + [pa.array(scores, pa.float64()), pa.array((scores >= cut).astype(np.int32))], [*names, "score", "predicted"])

    schema = ", ".join([*(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in names), "score double", "predicted int"])
    return small_batches(wide).mapInArrow(score, schema)
