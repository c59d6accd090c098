"""Shared helpers for the text operators: vectorised word hashing over Arrow text.

A *word* is a maximal run of bytes other than space and 0x09-0x0D, with A-Z
lower-cased.  UTF-8 continuation bytes are never separators, so words can be
found and hashed on the raw bytes of a whole Arrow batch, with no Python
string per word.
"""

from __future__ import annotations

import os
import re
import tempfile
from typing import Iterator, NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BASE_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_SEGMENT = 1 << 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_GAP = np.zeros(256, dtype=bool)
_IS_GAP[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection of 64-bit values."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTE_CODE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x2545F4914F6CDD1D))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_POWERS = _powers(_BASE, _SEGMENT + 1)
_INVERSES = _powers(_BASE_INVERSE, _SEGMENT + 1)


class Words(NamedTuple):
    """Words of a batch of texts, in order: 64-bit hash, and the word range of each text."""

    hashes: np.ndarray
    first: np.ndarray  # first[i]:first[i + 1] are the words of text i
    start: np.ndarray  # byte positions in the batch's text buffer
    end: np.ndarray


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the n + 1 offsets of its texts; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], dtype=np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    if len(offsets) == 0:
        offsets = np.zeros(1, np.int64)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def _hash_segment(code: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the words start:end of code (bytes, lower-cased)."""
    n = len(code)
    powers, inverses = (_POWERS, _INVERSES) if n < len(_POWERS) else (_powers(_BASE, n + 1), _powers(_BASE_INVERSE, n + 1))
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(_BYTE_CODE[code] * powers[:n], out=sums[1:])
    return mix64((sums[end] - sums[start]) * inverses[start])


def words_of(column: pa.Array) -> Words:
    """All words of the texts of a column; null and empty texts have none."""
    data, offsets = text_buffer(column)
    n = len(data)
    if n == 0:
        none = np.zeros(0, np.int64)
        return Words(np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64), none, none)
    lower = _LOWER[data]
    solid = ~_IS_GAP[data]
    starts, ends = solid.copy(), solid.copy()
    starts[1:] &= ~solid[:-1]
    ends[:-1] &= ~solid[1:]
    inner = offsets[(offsets > 0) & (offsets < n)]
    starts[inner] = solid[inner]
    ends[inner - 1] = solid[inner - 1]
    start, end = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    hashes = np.empty(len(start), dtype=np.uint64)
    at = 0
    while at < len(start):  # segments of whole words, of about _SEGMENT bytes
        stop = max(at + 1, int(np.searchsorted(end, start[at] + _SEGMENT, side="right")))
        low, high = start[at], end[stop - 1]
        hashes[at:stop] = _hash_segment(lower[low:high], start[at:stop] - low, end[at:stop] - low)
        at = stop
    return Words(hashes, np.searchsorted(start, offsets), start, end)


_LANES = [np.uint64(c) for c in (0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F)]


def shingle_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of size words, order-sensitive; entry i starts at word i."""
    if len(hashes) < size:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(hashes) - size + 1, dtype=np.uint64)
    for k in range(size):
        part = hashes[k : len(hashes) - size + 1 + k]
        # Each place has its own odd multiplier; further places turn the bits too.
        out += (part ^ (part >> np.uint64(29 + k // len(_LANES)))) * (_LANES[k % len(_LANES)] + np.uint64(2 * (k // len(_LANES))))
    return mix64(out)


def whole_hash(hashes: np.ndarray) -> np.ndarray:
    """One hash for a whole short word sequence; sequences of different length differ."""
    return mix64(shingle_hashes(hashes, len(hashes)) + np.uint64(len(hashes)))


def shingle_sets(words: Words, size: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text; a text with fewer words is one shingle."""
    every = shingle_hashes(words.hashes, size)
    for low, high in zip(words.first[:-1].tolist(), words.first[1:].tolist()):
        if high - low >= size:
            found = np.sort(every[low : high - size + 1])
            keep = np.empty(len(found), bool)
            keep[0] = True
            np.not_equal(found[1:], found[:-1], out=keep[1:])
            yield found[keep]
        elif high > low:
            yield whole_hash(words.hashes[low:high])
        else:
            yield np.zeros(0, np.uint64)


def slices(batch: pa.RecordBatch, column: str, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of a batch holding about limit bytes of text, one row at least, so that temporaries stay small."""
    _, offsets = text_buffer(batch.column(column))
    at, n = 0, batch.num_rows
    while at < n:
        stop = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1)
        yield batch.slice(at, min(stop, n) - at)
        at = stop
    pa.default_memory_pool().release_unused()  # workers live on through other stages


#: Bytes of an Arrow batch, of which Spark and a worker hold several each.
BATCH_BYTES = 8 << 20
_BATCH_SETTING, _BATCH_DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"


def small_batches(df: DataFrame) -> DataFrame:
    """df, after its session was set to Arrow batches of BATCH_BYTES, where it has Spark's own limit: rows of text are long."""
    conf = df.sparkSession.conf
    if conf.get(_BATCH_SETTING) == _BATCH_DEFAULT:
        conf.set(_BATCH_SETTING, str(BATCH_BYTES))
    return df


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where it is unset and there is one machine, as in tests, a temporary one is set."""
    context = spark.sparkContext._jsc.sc()
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if context.getCheckpointDir().isDefined():
            return context.getCheckpointDir().get()
        if not re.fullmatch(r"local(\[[^\]]*\])?", context.master()):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = os.path.join(tempfile.gettempdir(), "tidewell-checkpoints")
    if not context.getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(found)
    return found


def saved(df: DataFrame, *partition_by: str) -> DataFrame:
    """Writes df to the shared folder and returns it reread: executors may be lost, its lineage is cut."""
    import uuid

    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/tidewell-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.saved_at = path
    return out


def discard(*frames: DataFrame) -> None:
    """Deletes the files of frames that saved() returned; what was made from them must have been saved."""
    for df in frames:
        jvm, jsc = df.sparkSession._jvm, df.sparkSession.sparkContext._jsc
        path = jvm.org.apache.hadoop.fs.Path(df.saved_at)
        path.getFileSystem(jsc.hadoopConfiguration()).delete(path, True)
