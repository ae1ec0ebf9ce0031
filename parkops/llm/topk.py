"""Exact top-k by inner product, block at a time (operator 3).

Terms are the vector components. Vectors are put in an order that keeps similar ones
together (nearest of a few pivots), and consecutive runs form blocks. A block keeps its
vectors (the forward index) and each term's largest and smallest value. A query sums,
over its terms, the most a block's vectors can reach; blocks are scored in descending
order of that bound (one, then two, four, ... at a time) and the rest is skipped once the
bound falls below the query's current k-th score. Bounds never lie under a true score and equal ones are still scored,
so results are exact, ties included.

Blocks come in shards of bounded size. Each query first searches its own shard, which
gives its k-th score a good start, and then meets the other shards in blocks of queries.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parkops.llm.common import to_batch, written

PIVOTS = 64
BLOCK = 128
SHARD = 8192
QUERIES = 2048
#: Hits that are held before each query's best are kept only.
HITS_HELD = 1 << 18

_SHARDS = pa.schema([("shard", pa.int64()), ("n", pa.int32()), ("dims", pa.int32()),
                     ("width", pa.int32()), ("ids", pa.binary()), ("vectors", pa.binary())])
SHARDS = "shard long, n int, dims int, width int, ids binary, vectors binary"
_BLOCKS = pa.schema([("home", pa.int64()), ("n", pa.int32()), ("dims", pa.int32()),
                     ("width", pa.int32()), ("ids", pa.binary()), ("vectors", pa.binary()),
                     ("kth", pa.binary()), ("hit_query", pa.binary()), ("hit_id", pa.binary()),
                     ("hit_score", pa.binary())])
BLOCKS = ("home long, n int, dims int, width int, ids binary, vectors binary, kth binary, "
          "hit_query binary, hit_id binary, hit_score binary")
_HITS = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])
HITS = "query_id long, vec_id long, score long"


def quantised(rows: list, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """(which rows take part, their integer vectors): floor(scale * x) of each component.
    Null vectors, and those with a null or non-finite component, take no part; shorter
    vectors count as zero in the components they lack."""
    keep, out = [], []
    dims = max((len(r) for r in rows if r is not None), default=0)
    for i, r in enumerate(rows):
        if r is None or any(x is None for x in r):
            continue
        v = np.floor(np.asarray(r, np.float64) * scale)
        if np.isfinite(v).all():
            keep.append(i)
            out.append(np.pad(v, (0, dims - len(v))))
    return np.array(keep, np.int64), np.array(out).reshape(len(keep), dims)


def shards(vectors: DataFrame, scale: float = 64.0, shard: int = SHARD) -> DataFrame:
    """The table of shards from (vec_id, embedding); rows without a vec_id take no part."""
    rows = (vectors.filter(F.col("vec_id").isNotNull())
            .groupBy(F.col("vec_id").cast("long").alias("vec_id"))
            .agg(F.min("embedding").alias("embedding")))
    # a bounded sample that only decides the order; any order gives exact results
    pivots = quantised([r.embedding for r in rows.orderBy(F.xxhash64("vec_id")).limit(PIVOTS)
                        .collect()], scale)[1]
    schema = pa.schema([("pivot", pa.int32()), ("vec_id", pa.int64()),
                        ("vector", pa.list_(pa.float64()))])

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep, v = quantised(b.column(1).to_pylist(), scale)
            d = min(v.shape[1], pivots.shape[1]) if len(pivots) else 0
            at = (v[:, :d] @ pivots[:, :d].T).argmax(1) if d and len(v) else np.zeros(len(v))
            ids = b.column(0).take(pa.array(keep))
            yield pa.RecordBatch.from_arrays(
                [pa.array(at.astype(np.int32)), ids, pa.array(list(v), pa.list_(pa.float64()))],
                schema=schema)

    placed = written(rows.mapInArrow(near, "pivot int, vec_id long, vector array<double>"),
                     "vectors")
    n = max(1, -(-placed.count() // shard))
    # ranges of (pivot, hash): a pivot with most of the vectors is split over shards
    ranged = placed.repartitionByRange(n, "pivot", F.xxhash64("vec_id")) \
        .sortWithinPartitions("pivot", "vec_id")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        part, made, ids, vecs = TaskContext.get().partitionId(), 0, [], []

        def row() -> pa.RecordBatch:
            dims = max(map(len, vecs))
            width, raw = _packed(np.array([np.pad(x, (0, dims - len(x))) for x in vecs]))
            return to_batch([((part << 32) + made, len(ids), dims, width,
                              np.array(ids, "<i8").tobytes(), raw)], _SHARDS)
        for b in batches:
            for i, v in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                ids.append(i)
                vecs.append(np.array(v, np.float64))
                if len(ids) == shard:
                    yield row()
                    made, ids, vecs = made + 1, [], []
        if ids:
            yield row()

    return written(ranged.mapInArrow(build, SHARDS), "shards")


def _packed(v: np.ndarray) -> tuple[int, bytes]:
    """(bytes a component, the vectors): two bytes where they are enough."""
    small = np.abs(v).max(initial=0) < 1 << 15
    return (2, v.astype("<i2").tobytes()) if small else (8, v.astype("<f8").tobytes())


def _matrix(raw: bytes, n: int, dims: int, width: int) -> np.ndarray:
    return np.frombuffer(raw, "<i2" if width == 2 else "<f8").reshape(n, dims).astype(np.float64)


def _fit(m: np.ndarray, dims: int) -> np.ndarray:
    return np.pad(m, ((0, 0), (0, dims - m.shape[1]))) if m.shape[1] < dims else m


def _long(m: np.ndarray) -> np.ndarray:
    """Whole numbers of any size as the nearest long but the least, which means none."""
    return np.clip(m, 1 - (1 << 63), (1 << 63) - 1).astype(np.int64) if m.dtype == object else m


def search(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, v: np.ndarray, k: int,
           floor: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, vec_id, score) of each query's best ``k`` among ``ids`` with scores of
    at least ``floor``, itself excluded; ties to smaller ids."""
    dims = max(q.shape[1], v.shape[1])
    q, v = _fit(q, dims), _fit(v, dims)
    big = max(np.abs(q).max(initial=0), 1) * max(np.abs(v).max(initial=0), 1) * dims
    if big < 1 << 24:  # every sum is a whole number that a single holds exactly
        q, v = q.astype(np.float32), v.astype(np.float32)
    if big >= 1 << 53:  # beyond what doubles hold exactly
        # from 2**62 on in whole numbers of any size, scores beyond a long as the nearest long
        q, v = ((np.vectorize(int, otypes=[object])(m) for m in (q, v)) if big >= 1 << 62
                else (m.astype(np.int64) for m in (q, v)))
    cuts = range(0, len(ids), block)
    tops = np.maximum.reduceat(v, list(cuts))
    lows = np.minimum.reduceat(v, list(cuts))
    bound = _long(np.maximum(q, 0) @ tops.T + np.minimum(q, 0) @ lows.T)
    order = np.argsort(-bound, axis=1, kind="stable")
    kth = floor.copy()
    held = [tuple(np.zeros(0, np.int64) for _ in range(3))]

    def merge() -> None:
        """Each query's best ``k`` of what is held, by score and id; its k-th is raised."""
        row, hit, score = (np.concatenate(c) for c in zip(*held))
        by = np.lexsort((hit, ~score, row))
        new = np.flatnonzero(np.r_[True, np.diff(row[by]) != 0]) if len(by) else by
        nth = np.arange(len(by)) - np.repeat(new, np.diff(np.r_[new, len(by)]))
        last = by[nth == k - 1]
        kth[row[last]] = np.maximum(kth[row[last]], score[last])
        by = by[nth < k]
        held[:] = [(row[by], hit[by], score[by])]

    active = np.arange(len(q))
    r, step = 0, 1
    while r < order.shape[1]:  # each query's next block, then its next two, four and so on
        active = active[bound[active, order[active, r]] >= kth[active]]
        if not len(active):
            break
        due = np.zeros((len(active), order.shape[1]), bool)
        np.put_along_axis(due, order[active, r:r + step], True, 1)
        for b in np.flatnonzero(due.any(0)):
            rows = active[due[:, b]]
            rows = rows[bound[rows, b] >= kth[rows]]
            if not len(rows):
                continue
            a = b * block
            own = ids[a:a + block]
            s = _long(q[rows] @ v[a:a + block].T)
            at, col = np.nonzero(s >= kth[rows, None])
            other = own[col] != q_ids[rows[at]]
            at, col = at[other], col[other]
            held.append((rows[at], own[col], np.rint(s[at, col]).astype(np.int64)
                         if s.dtype != np.int64 else s[at, col]))
            if sum(len(x[0]) for x in held[1:]) >= HITS_HELD:
                merge()
        merge()
        r, step = r + step, 2 * step
    return held[0]


def top_k(vectors: DataFrame, every: int = 20, k: int = 20, scale: float = 64.0,
          shard: int = SHARD) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` highest scores (all, if fewer) of every
    row whose vec_id is divisible by ``every``, over all other rows; ties to smaller
    vec_ids. ``vec_id`` is a key: of rows that repeat one, the least vector counts. A score
    beyond a long is given, and ranked, as the nearest long."""
    table = shards(vectors, scale, shard)
    names = [r.shard for r in table.select("shard").collect()]  # one number a shard

    def home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, n, dims, width, ids, raw in zip(*(c.to_pylist() for c in b.columns)):
                ids, v = np.frombuffer(ids, "<i8"), _matrix(raw, n, dims, width)
                for some in np.array_split(own := np.flatnonzero(ids % every == 0),
                                           max(1, -(-len(own) // QUERIES))):
                    if not len(some):
                        continue
                    lowest = np.full(len(some), np.iinfo(np.int64).min, np.int64)
                    row, hit, score = search(ids[some], v[some], ids, v, k, lowest)
                    found = np.bincount(row, minlength=len(some))
                    np.minimum.at(floor := np.full(len(some), np.iinfo(np.int64).max), row, score)
                    floor = np.where(found == k, floor, lowest)
                    kind, packed = _packed(v[some])
                    yield to_batch([(name, len(some), dims, kind, ids[some].tobytes(), packed,
                                     floor.astype("<i8").tobytes(),
                                     ids[some][row].astype("<i8").tobytes(),
                                     hit.astype("<i8").tobytes(), score.astype("<i8").tobytes())],
                                   _BLOCKS)

    blocks = written(table.mapInArrow(home, BLOCKS), "queries")

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for cols in zip(*(c.to_pylist() for c in b.columns)):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.frombuffer(c, "<i8")) for c in cols], schema=_HITS)

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for nq, dq, wq, qi, qv, floor, n, dims, width, ids, raw in zip(
                    *(c.to_pylist() for c in b.columns)):
                qi = np.frombuffer(qi, "<i8")
                row, hit, score = search(qi, _matrix(qv, nq, dq, wq), np.frombuffer(ids, "<i8"),
                                         _matrix(raw, n, dims, width), k,
                                         np.frombuffer(floor, "<i8"))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(qi[row]), pa.array(hit), pa.array(score)], schema=_HITS)

    # Spark sizes an exploded block as one row, and would broadcast all of them: that is ruled out
    met = (blocks.select(F.explode(F.array(*map(F.lit, names)).cast("array<bigint>")).alias("shard"),
                         "home", F.col("n").alias("nq"), F.col("dims").alias("dq"),
                         F.col("width").alias("wq"), F.col("ids").alias("qi"),
                         F.col("vectors").alias("qv"), "kth")
           .filter(F.col("shard") != F.col("home")).join(table.hint("merge"), "shard")
           .select("nq", "dq", "wq", "qi", "qv", "kth", "n", "dims", "width", "ids", "vectors"))
    hits = (blocks.select("hit_query", "hit_id", "hit_score").mapInArrow(first, HITS)
            .unionByName(met.mapInArrow(others, HITS)))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (hits.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
