"""Exact top-k inner-product search over an impact-ordered index, a score at a time.

Vectors are quantised to integers.  The index cuts them into blocks; in a
block, each dimension has its postings in order of value, cut into segments of
like impact.  A segment's impact for a query is the weight times its highest
excess over the block's least contribution, quantised to QUANTA levels of the
query's greatest.  Segments are processed level by level from the highest; as
long as more is left than the k-th best score found, so that no vector can be
ruled out, levels are read on.  Then after each level the k-th best exact score
so far is held against what every other vector can still reach: its excess and
the largest impacts left.  Search stops only when that proves all but a few
vectors out, and those few are rescored exactly.

One block is searched first; its k-th best scores are floors for the others, of
which those that cannot reach them are passed over before a posting is read.
"""

from __future__ import annotations

from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .textcore import saved

#: Segments of a dimension in a block, and levels of quantised impact.
LEVELS = 8
QUANTA = 8
BLOCK_ROWS = 8192
QUERY_ROWS = 512
QUERIES_AT_ONCE = 128
LOWEST = -(1 << 62)
#: So many postings of so many dimensions give a query its first k-th best score.
HEADS = 16


class ImpactBlock:
    """The postings of one block of integer vectors."""

    def __init__(self, ids: np.ndarray, matrix: np.ndarray, order: np.ndarray | None = None):
        self.ids, self.matrix = ids, matrix
        self.levels_left: list[int] = []  # by query, when it was stopped
        n, dims = matrix.shape
        self.order = np.argsort(matrix, axis=0, kind="stable").T.astype(np.int32).copy() if order is None else order
        self.values = np.take_along_axis(matrix.T, self.order.astype(np.int64), axis=1)
        self.low, self.high = self.values[:, 0].astype(np.int64), self.values[:, -1].astype(np.int64)
        # edges[d, l]: the value where level l of dimension d begins; starts[d, l]: its first posting.
        steps = np.arange(LEVELS + 1)
        self.edges = self.low[:, None] + -(-(self.high - self.low)[:, None] * steps[None, :] // LEVELS)
        self.starts = np.stack([np.searchsorted(self.values[d], self.edges[d], side="left") for d in range(dims)]) if dims else np.zeros((0, LEVELS + 1), np.int64)
        if dims:
            self.starts[:, LEVELS] = n

    def search(self, queries: np.ndarray, k: int, own: np.ndarray, floors: np.ndarray | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each query (a row) the k best (ids, scores), ties to smaller ids; candidates of id own[i] are left out.

        With floors, only scores that reach a query's floor are sure to be given.
        """
        queries = queries.astype(np.int64)
        out: list = [None] * len(queries)
        floors = np.full(len(queries), LOWEST) if floors is None else floors
        if len(self.ids) <= 4 * k or not self.matrix.shape[1]:
            return [self._best(np.flatnonzero(self.ids != o), q, k) for q, o in zip(queries, own)]
        for low in range(0, len(queries), QUERIES_AT_ONCE):
            part = slice(low, low + QUERIES_AT_ONCE)
            self._search(queries[part], k, own[part], floors[part], out, low)
        return out

    def _search(self, queries: np.ndarray, k: int, own: np.ndarray, floors: np.ndarray, out: list, at: int) -> None:
        n, dims = self.matrix.shape
        # The excess of a posting over its dimension's least contribution is not negative.
        reference = np.where(queries > 0, self.low[None, :], self.high[None, :])
        base = (queries * reference).sum(axis=1)
        reach = np.abs(queries) * (self.high - self.low)[None, :]
        none = np.flatnonzero(base + reach.sum(axis=1) < floors)
        for q in none.tolist():
            out[at + q] = self._best(np.zeros(0, np.int64), queries[q], k)
        live = np.setdiff1d(np.arange(len(queries)), none)
        if not len(live):
            return
        kind = np.int64 if reach.sum(axis=1).max() >= 1 << 30 else np.int32
        # impact[q, d, l]: the highest impact in the l-th segment by value; one beyond counts as 0.
        rise = np.where((queries > 0)[:, :, None], self.edges[None, :, 1:] - self.low[None, :, None], self.high[None, :, None] - self.edges[None, :, :-1])
        impact = np.abs(queries)[:, :, None] * rise
        quantum = impact * QUANTA // (impact.max(axis=(1, 2), keepdims=True) + 1)
        # left[q, l]: what a vector can still gain once the levels from l up have been read.
        left = np.stack([np.where(quantum < level, impact, 0).max(axis=2).sum(axis=1) for level in range(QUANTA)], axis=1)
        least = np.maximum(floors, [self._start(q, k, o) for q, o in zip(queries, own)]) - base
        # Until less is left than the k-th best score no vector can be ruled out, so levels down to there are read at once.
        level = np.array([int(np.flatnonzero(x < y)[-1]) if (x < y).any() else 0 for x, y in zip(left, least)])
        fresh = True
        excess = np.zeros((n, len(live)), dtype=kind)
        while len(live):
            now = quantum[live] >= level[live][:, None, None] if fresh else quantum[live] == level[live][:, None, None]
            fresh = False
            for d in range(dims):
                for part in np.flatnonzero(now[:, d].any(axis=0)).tolist():
                    a, b = int(self.starts[d, part]), int(self.starts[d, part + 1])
                    w = np.where(now[:, d, part], queries[live, d], 0)
                    if a < b and w.any():
                        excess[self.order[d, a:b]] += np.multiply.outer(self.values[d, a:b].astype(kind), w.astype(kind)) - (w * reference[live, d]).astype(kind)[None, :]
            going = []
            for column, q in enumerate(live.tolist()):
                allowed = np.flatnonzero(self.ids != own[q])
                lead = allowed[np.argpartition(-excess[allowed, column], k - 1)[:k]]
                least[q] = max(int(least[q]), int((self.matrix[lead].astype(np.int64) @ queries[q]).min()) - int(base[q]))
                possible = allowed[excess[allowed, column] + (int(left[q, level[q]]) if level[q] else 0) >= least[q]]
                if not level[q] or len(possible) <= max(4 * k, n // 8):
                    self.levels_left.append(int(level[q]))
                    out[at + q] = self._best(possible, queries[q], k)
                else:
                    going.append(column)
            excess, live = excess[:, going].copy(), live[going]
            level[live] -= 1

    def _start(self, query: np.ndarray, k: int, own: int) -> int:
        """A score that k vectors reach: the k-th best of those at the heads of the heaviest dimensions."""
        heavy = np.argsort(-np.abs(query) * (self.high - self.low))[:HEADS]
        rows = np.unique(np.concatenate([self.order[d, -HEADS:] if query[d] > 0 else self.order[d, :HEADS] for d in heavy]))
        rows = rows[self.ids[rows] != own]
        return int(np.sort(self.matrix[rows].astype(np.int64) @ query)[-k]) if len(rows) >= k else LOWEST

    def _best(self, rows: np.ndarray, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        scores = self.matrix[rows].astype(np.int64) @ query
        order = np.lexsort((self.ids[rows], -scores))[:k]
        return self.ids[rows][order], scores[order]


def quantised(df: DataFrame, key: str = "vec_id", vector: str = "embedding", scale: int = 256) -> DataFrame:
    """(id, v): floor(scale * x) of each component; vectors null, empty or with null or non-finite components go."""
    x = F.col(f"`{vector}`").cast("array<double>")
    fine = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    rows = df.where(F.col(f"`{key}`").isNotNull() & x.isNotNull() & (F.size(x) > 0) & F.coalesce(fine, F.lit(False)))
    return rows.select(F.col(f"`{key}`").cast("long").alias("id"), F.transform(x, lambda c: F.floor(c * scale).cast("long")).alias("v"))


def _packed(group: pa.Table, with_order: bool) -> pa.Table:
    ids = group["id"].to_numpy()
    lists = group["v"].combine_chunks()
    lengths = np.diff(np.asarray(lists.offsets))
    matrix = np.zeros((len(ids), int(lengths.max())), dtype=np.int64)
    matrix[np.arange(matrix.shape[1])[None, :] < lengths[:, None]] = np.asarray(lists.values)[lists.offsets[0].as_py() : lists.offsets[-1].as_py()]
    narrow = np.int16 if np.abs(matrix).max(initial=0) < 1 << 15 else np.int64
    out = {"block": group["block"].slice(0, 1), "ids": pa.array([ids.tobytes()]), "dims": pa.array([matrix.shape[1]], pa.int32()), "width": pa.array([np.dtype(narrow).itemsize], pa.int32()), "matrix": pa.array([matrix.astype(narrow).tobytes()])}
    if "floor" in group.column_names:
        out["floors"] = pa.array([group["floor"].to_numpy().astype(np.int64).tobytes()])
    if with_order:
        out["postings"] = pa.array([ImpactBlock(ids, matrix).order.astype(np.int16 if len(ids) < 1 << 15 else np.int32).tobytes()])
    return pa.table(out)


_BLOCK = "block int, ids binary, dims int, width int, matrix binary"


def _unpacked(ids: bytes, dims: int, width: int, matrix: bytes) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(ids, np.int64), np.frombuffer(matrix, np.int16 if width == 2 else np.int64).reshape(-1, dims)


def _wide(matrix: np.ndarray, dims: int) -> np.ndarray:
    """Absent components count as 0."""
    return np.pad(matrix, ((0, 0), (0, dims - matrix.shape[1]))) if matrix.shape[1] < dims else matrix


def _groups(asked: DataFrame) -> DataFrame:
    """Queries with their floors, a group a row."""
    packed = asked.groupBy("block").applyInArrow(lambda t: _packed(t, False), f"{_BLOCK}, floors binary")
    return packed.select(F.col("block").alias("g"), *[F.col(c).alias(f"q_{c}") for c in ("ids", "dims", "width", "matrix", "floors")])


def _hits(index: DataFrame, sought: DataFrame, groups: int, k: int) -> DataFrame:
    """(query_id, vec_id, score): the best of each block for each query; each block goes to each group of queries, both of bounded size."""
    both = index.withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).join(sought, "g")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                ids, matrix = _unpacked(r["ids"], r["dims"], r["width"], r["matrix"])
                q_ids, q_matrix = _unpacked(r["q_ids"], r["q_dims"], r["q_width"], r["q_matrix"])
                dims = max(r["dims"], r["q_dims"])
                order = np.frombuffer(r["postings"], np.int16 if len(ids) < 1 << 15 else np.int32).reshape(r["dims"], -1)
                block = ImpactBlock(ids, matrix, order) if r["dims"] == dims else ImpactBlock(ids, _wide(matrix, dims))
                found = block.search(_wide(q_matrix, dims), k, q_ids, np.frombuffer(r["q_floors"], np.int64))
                columns = np.repeat(q_ids, [len(x[1]) for x in found]), np.concatenate([x[0] for x in found]), np.concatenate([x[1] for x in found])
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["query_id", "vec_id", "score"])

    return both.repartition("g", "block").mapInArrow(search, "query_id long, vec_id long, score long")


def top_k(df: DataFrame, queries: DataFrame, k: int = 5, key: str = "vec_id", vector: str = "embedding", scale: int = 256, block_rows: int = BLOCK_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k best vectors of df by integer inner product.

    Rows of df with the query's own key are no candidates for it.  Ties go to
    the smaller key; with fewer candidates, all are given.  Unusable vectors
    (null, empty, null or non-finite components, or a null key) take no part;
    where lengths differ, absent components count as 0.  Repeated rows of df are
    candidates each; a repeated query key is answered once, for its smallest
    vector.  Empty tables give an empty result.

    Groups of queries meet blocks of the index, so the work is the product of
    the two tables less what the floors and proofs save (little, where scores
    are as close as those of random directions); nothing goes through the driver.
    Vectors of any length are read whole.
    """
    rows = saved(quantised(df, key, vector, scale))
    asked = saved(quantised(queries, key, vector, scale).groupBy("id").agg(F.min("v").alias("v")))
    n, m = rows.count(), asked.count()
    blocks, groups = -(-n // block_rows) or 1, -(-m // query_rows) or 1
    deal = lambda frame, parts: frame.withColumn("block", F.pmod(F.xxhash64("id", "v"), F.lit(parts)).cast("int"))
    index = saved(deal(rows, blocks).groupBy("block").applyInArrow(lambda t: _packed(t, True), f"{_BLOCK}, postings binary"))
    leading = index.where("block = 0")
    first = saved(_hits(leading, _groups(deal(asked.withColumn("floor", F.lit(LOWEST)), groups)), groups, k))
    floors = first.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("floor")).where(F.col("n") >= k)
    floored = asked.join(floors, F.col("id") == F.col("query_id"), "left").select("id", "v", F.coalesce("floor", F.lit(LOWEST)).alias("floor"))
    hits = first.unionByName(_hits(index.where("block <> 0"), _groups(deal(floored, groups)), groups, k))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def oracle_sql(table: str = "embeddings", key: str = "vec_id", vector: str = "embedding", every: int = 50, k: int = 5, scale: int = 256) -> str:
    """The same search as DuckDB SQL, all scores computed."""
    return f"""
WITH usable AS (
  SELECT {key} AS id, list_transform({vector}, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM {table}
  WHERE {vector} IS NOT NULL AND len(list_filter({vector}, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS (SELECT id, unnest(v) AS x, generate_subscripts(v, 1) AS d FROM usable),
scores AS (
  SELECT q.id AS query_id, c.id AS vec_id, CAST(sum(q.x * c.x) AS BIGINT) AS score
  FROM parts q JOIN parts c ON q.d = c.d AND q.id <> c.id WHERE q.id % {every} = 0 GROUP BY q.id, c.id)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scores) WHERE rank <= {k}"""
