"""Documents in blocks, and which keys occur in more than one of them.

A block holds a few megabytes of whole texts in one row, so passes over the corpus meet
the same documents in the same order and one task works on whole arrays. ``shared_keys``
tells each block which of its (hashed) keys other owners have too: blocks send their
sorted distinct keys to ranges of the hash space, four bytes a key, and get counts back.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parkops.llm.common import NULL_ID, release, tidy, to_batch, written

BLOCK_BYTES = 2 << 20
#: Keys a range of the hash space holds at most, about.
RANGE_KEYS = 4 << 20

_BLOCKS = pa.schema([("block", pa.int64()), ("docs", pa.binary()), ("nulls", pa.binary()),
                     ("lengths", pa.binary()), ("data", pa.binary()), ("rest", pa.binary()),
                     ("extra", pa.binary()), ("n_keys", pa.int64())])
BLOCKS = ("block long, docs binary, nulls binary, lengths binary, data binary, rest binary, "
          "extra binary, n_keys long")


class Block:
    """Texts of a block as one byte array, with each document's place."""

    def __init__(self, docs: bytes, lengths: bytes, data: bytes) -> None:
        self.docs = np.frombuffer(docs, "<i8")
        self.lengths = np.frombuffer(lengths, "<i8")
        self.ends = np.cumsum(self.lengths)
        self.starts = self.ends - self.lengths
        self.data = np.frombuffer(zstandard.decompress(data), np.uint8) if self.lengths.sum() \
            else np.zeros(0, np.uint8)


def in_blocks(docs: DataFrame, rest: list[str], extra: Callable[[Block], tuple[bytes, int]],
              block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Write ``docs`` in blocks, bucketed by block: passes join a block to what others sent
    it. ``rest``: further columns to carry along. ``extra`` computes once per block what
    later passes need again, and its number of keys."""
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made = TaskContext.get().partitionId(), 0
        held: list[pa.RecordBatch] = []
        size = 0

        def row() -> pa.RecordBatch:
            b = pa.Table.from_batches(held).combine_chunks()
            ids = b.column(0).to_pylist()
            texts = [t.encode() for t in b.column(1).to_pylist()]
            names = np.array([NULL_ID if i is None else i for i in ids], "<i8").tobytes()
            lengths = np.array([len(t) for t in texts], "<i8").tobytes()
            data = zstandard.compress(b"".join(texts), 1)
            more = b""
            if rest:
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, (t := b.select(range(2, b.num_columns))).schema) as w:
                    w.write_table(t)
                more = zstandard.compress(sink.getvalue().to_pybytes(), 1)
            kept, n = extra(Block(names, lengths, data))
            nulls = np.packbits([i is None for i in ids]).tobytes()
            return to_batch([((part << 32) + made, names, nulls, lengths, data, more, kept, n)],
                            _BLOCKS)

        for b in batches:
            width = pc.binary_length(b.column(1))
            a = 0
            for i, n in enumerate(width.to_pylist()):
                size += n
                if size >= block_bytes:
                    held.append(b.slice(a, i + 1 - a))
                    yield row()
                    held, size, a, made = [], 0, i + 1, made + 1
            if a < b.num_rows:
                held.append(b.slice(a))
        if held:
            yield row()

    cols = [F.col("doc_id").cast("long").alias("_d"),
            F.coalesce(F.col("text"), F.lit("")).alias("_t"),
            *(F.col(c).alias(f"_{i}") for i, c in enumerate(rest))]
    return written(docs.select(*cols).mapInArrow(tidy(build), BLOCKS), "blocks", "block")


def shared_keys(table: DataFrame, keys: Callable[[Block, bytes], tuple[np.ndarray, np.ndarray]],
                total: int, codes: tuple[np.ndarray, np.ndarray] | None = None) -> DataFrame:
    """(block, counts, most): for each block's sorted distinct 64-bit ``keys`` how often they
    occur over all blocks, as u16 (65535: at least as often) in the same order,
    and the largest of them.

    ``keys`` gives (sorted distinct keys, occurrences in the block). A range of the hash
    space is chosen by the key's leading bits and compares the next 32; two keys that
    agree on all of these are taken for one, so counts may be too high, never too low.
    With ``codes`` the occurrences are places (below 256) in its two arrays: of owners (1, or
    2 for several) and of occurrences; a key with one owner then counts as 1.
    """
    bits = 6
    while (1 << bits) * RANGE_KEYS < total and bits < 24:
        bits += 1
    sent = pa.schema([("range", pa.int32()), ("block", pa.int64()), ("keys", pa.binary()),
                      ("times", pa.binary())])

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, docs, lengths, data, extra in zip(*(c.to_pylist() for c in b.columns)):
                k, n = keys(Block(docs, lengths, data), extra)
                low = ((k >> np.uint64(32 - bits)) & np.uint64(0xffffffff)).astype("<u4")
                n = np.minimum(n, 255).astype(np.uint8)
                cut = np.searchsorted(k >> np.uint64(64 - bits),
                                      np.arange((1 << bits) + 1, dtype=np.uint64)).tolist()
                yield to_batch([(r, block, low[a:z].tobytes(), n[a:z].tobytes())
                                for r, (a, z) in enumerate(zip(cut, cut[1:])) if z > a], sent)

    def meet(group: pa.Table) -> pa.Table:
        keys = [np.frombuffer(k, "<u4") for k in group.column("keys").to_pylist()]
        times = [np.frombuffer(n, np.uint8) for n in group.column("times").to_pylist()]
        every = np.concatenate(keys)
        order = np.argsort(every, kind="stable")
        s = every[order]
        new = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
        t = np.concatenate(times)[order]
        if codes is None:
            sums = np.add.reduceat(t.astype(np.int64), new)
        else:
            owners, sums = (np.add.reduceat(c[t], new, dtype=np.int64) for c in codes)
            sums = np.where(owners < 2, 1, np.maximum(sums, 2))
        counts = np.empty(len(every), "<u2")
        counts[order] = np.repeat(np.minimum(sums, 65535), np.diff(np.r_[new, len(s)]))
        cut = np.cumsum([0, *map(len, keys)]).tolist()
        del order, s, every, times, t, sums
        release()
        return pa.table({"block": group.column("block"), "range": group.column("range"),
                         "counts": pa.array([counts[a:z].tobytes() for a, z in zip(cut, cut[1:])]),
                         "most": pa.array([int(counts[a:z].max()) for a, z in zip(cut, cut[1:])],
                                          pa.int32())})

    ranges = (table.select("block", "docs", "lengths", "data", "extra")
              .mapInArrow(tidy(send), "range int, block long, keys binary, times binary"))
    back = ranges.groupBy("range").applyInArrow(meet, "block long, range int, counts binary, most int")
    # a block has at most one row a range
    return written(back, "counts").groupBy("block").agg(
        F.sort_array(F.collect_list(F.struct("range", "counts"))).alias("counts"),
        F.max("most").alias("most"))


def joined(parts: list | None, dtype: str) -> np.ndarray:
    """The values that ``shared_keys`` and its like sent back, in order."""
    return np.frombuffer(b"".join(list(p.values())[1] for p in parts or []), dtype)
