"""Token ids in a word-aligned binary format (operator 6).

Simple-8b: every 64-bit word holds a 4-bit selector and 60 bits of equally wide
values; the selector says how many. A value of more than 60 bits is escaped: its word
holds an index into the block's list of full 64-bit values. A block of ``BLOCK``
values starts at a word boundary and the offsets of the blocks are kept, so blocks are
decoded on their own, all words of one selector at a time.

On disk a table of rows, one per run of documents in ascending doc_id order: the
documents' ids and lengths, the words, the escapes and the block offsets. Rows know
their part (a range of doc_ids), so positions over the whole corpus are sums over the
few parts that come before, read from the files.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parkops.llm.common import id_text, to_batch
from parkops.llm.words import in_batches, word_ends

#: (values in a word, bits of each) by selector; the last selector marks an escape.
LAYOUT = ((60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12),
          (4, 15), (3, 20), (2, 30), (1, 60))
ESCAPE = 15
BLOCK = 8192
ROW_IDS = 1 << 18

_COUNTS = np.zeros(16, np.int64)
_COUNTS[:len(LAYOUT)] = [c for c, _ in LAYOUT]
_COUNTS[ESCAPE] = 1

_ROWS = pa.schema([("part", pa.int64()), ("at", pa.int64()), ("first_doc", pa.int64()),
                   ("n_ids", pa.int64()),
                   ("docs", pa.binary()), ("null_docs", pa.int32()), ("lengths", pa.binary()),
                   ("words", pa.binary()), ("escapes", pa.binary()), ("offsets", pa.binary())])
ROWS = ("part long, at long, first_doc long, n_ids long, docs binary, null_docs int, lengths binary, "
        "words binary, escapes binary, offsets binary")


def _widths(values: np.ndarray) -> np.ndarray:
    """Bits of each value, exact for all of 64 bits."""
    high = (values >> np.uint64(32)).astype(np.float64)
    low = (values & np.uint64(0xffffffff)).astype(np.float64)
    wide = np.frexp(low)[1]
    big = np.flatnonzero(high)
    wide[big] = 32 + np.frexp(high[big])[1]
    return wide.astype(np.int8)


def pack_words(values: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words, escapes, block offsets) of unsigned values."""
    values = np.ascontiguousarray(values, np.uint64)
    n = len(values)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(1, np.int64)
    width = _widths(values)
    # the widest value from each place on, over the counts in ascending order; places
    # past a block's end are empty, so a block's last word may be partly filled
    edge = (np.arange(n) // block + 1) * block
    rows = -(-n // block)
    most = np.zeros((rows, block), np.int8)
    most.reshape(-1)[:n] = width
    choice = np.full((rows, block), ESCAPE, np.int8)
    span = 1
    for sel in range(len(LAYOUT) - 1, -1, -1):
        count, bits = LAYOUT[sel]
        while span < count:  # a maximum over span places from two over fewer
            move = min(span, count - span)
            most[:, :-move] = np.maximum(most[:, :-move], most[:, move:]) if move < block \
                else most[:, :-move]
            span += move
        np.putmask(choice, most <= bits, sel)
    choice = choice.reshape(-1)[:n]
    step = _COUNTS[choice].tolist()
    starts, offsets = [], [0]
    add = starts.append
    for a in range(0, n, block):
        i, b = a, min(n, a + block)
        while i < b:
            add(i)
            i += step[i]
        offsets.append(len(starts))
    at = np.array(starts, np.int64)
    sel = choice[at]
    words = sel.astype(np.uint64) << np.uint64(60)
    for s, (count, bits) in enumerate(LAYOUT):
        of = np.flatnonzero(sel == s)
        for j in range(count if len(of) else 0):
            src = at[of] + j
            ok = src < np.minimum(edge[at[of]], n)
            words[of[ok]] |= values[src[ok]] << np.uint64(j * bits)
    esc = np.flatnonzero(sel == ESCAPE)
    words[esc] |= np.arange(len(esc), dtype=np.uint64)
    return words, values[at[esc]], np.array(offsets, np.int64)


def unpack_words(words: np.ndarray, escapes: np.ndarray, offsets: np.ndarray, n: int,
                 block: int = BLOCK, first: int = 0, last: int | None = None) -> np.ndarray:
    """The values of blocks ``first`` to ``last`` (all by default)."""
    last = len(offsets) - 1 if last is None else last
    part = words[offsets[first]:offsets[last]]
    total = min(n, last * block) - first * block
    out = np.zeros(max(total, 0), np.uint64)
    if not len(part):
        return out
    sel = (part >> np.uint64(60)).astype(np.int64)
    counts = _COUNTS[sel]
    # places within each block: a block's count may run past its end in the last word
    of_block = np.repeat(np.arange(last - first), np.diff(offsets[first:last + 1]))
    ends = np.cumsum(counts)
    base = np.r_[0, ends[np.cumsum(np.diff(offsets[first:last + 1])) - 1]][of_block]
    at = of_block * block + (ends - counts) - base
    limit = np.minimum((of_block + 1) * block, total)
    for s, (count, bits) in enumerate(LAYOUT):
        of = np.flatnonzero(sel == s)
        mask = np.uint64((1 << bits) - 1)
        for j in range(count if len(of) else 0):
            ok = of[at[of] + j < limit[of]]
            out[at[ok] + j] = (part[ok] >> np.uint64(j * bits)) & mask
    of = np.flatnonzero(sel == ESCAPE)
    out[at[of]] = escapes[(part[of] & np.uint64((1 << 60) - 1)).astype(np.int64)]
    return out


def _row(part: int, at: int, docs: list, ids: list[bytes]) -> tuple:
    values = np.frombuffer(b"".join(ids), "<u4")
    words, escapes, offsets = pack_words(values)
    # nulls come first in ascending order, so their number is enough
    known = np.array([d for d in docs if d is not None], "<i8")
    return (part, at, int(known[0]) if len(known) else None, len(values), known.tobytes(),
            len(docs) - len(known), np.array([len(i) // 4 for i in ids], "<i8").tobytes(),
            words.astype("<u8").tobytes(), escapes.astype("<u8").tobytes(),
            offsets.astype("<i8").tobytes())


def write(docs: DataFrame, tokenizer: str, path: str, end_id: int = 2,
          parts: int | None = None) -> None:
    """Write the ids of all documents, each with ``end_id`` after it, to ``path`` in
    ascending doc_id order (nulls first). Null and empty texts have the end id only.
    ``parts``: ranges of doc_ids, by default the session's shuffle partitions."""
    spark = docs.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    end = end_id.to_bytes(4, "little")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        enc = word_ends(tokenizer)
        held, ids, size, at = [], [], 0, 0
        for b in batches:
            names, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            for some in in_batches(texts):
                for doc, raw in zip(names[some], enc.encode_many(texts[some])):
                    held.append(doc)
                    ids.append(raw + end)
                    size += len(raw) // 4 + 1
                    if size >= ROW_IDS:
                        yield to_batch([_row(part, at, held, ids)], _ROWS)
                        held, ids, size, at = [], [], 0, at + size
        if held:
            yield to_batch([_row(part, at, held, ids)], _ROWS)

    (id_text(docs).repartitionByRange(parts, F.asc_nulls_first("doc_id"))
     .sortWithinPartitions(F.asc_nulls_first("doc_id"), "text")
     .mapInArrow(encode, ROWS).write.parquet(path))


def read(spark: SparkSession, path: str) -> DataFrame:
    """Per document from the files: doc_id, start (ids before it in the corpus),
    n_tokens, ids (little-endian u32 bytes)."""
    rows = spark.read.schema(ROWS).parquet(path)
    return _documents(rows, "ids binary", lambda raw: raw)


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """As ``read`` with the unsigned crc32 of the ids in place of the ids."""
    rows = spark.read.schema(ROWS).parquet(path)
    return _documents(rows, "ids_crc32 long", zlib.crc32)


def _documents(rows: DataFrame, last: str, of: Callable) -> DataFrame:
    # one row a part; there are as many as the writer was told to make
    sizes = rows.groupBy("part").agg(
        F.min(F.coalesce("first_doc", F.lit(-(1 << 63)))).alias("_from"), F.sum("n_ids").alias("_n"))
    earlier = Window.orderBy("_from", "part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    placed = rows.join(F.broadcast(sizes), "part").select(
        (F.col("at") + F.col("_before")).alias("start"), "n_ids", "docs", "null_docs", "lengths",
        "words", "escapes", "offsets")
    name, kind = last.split()
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()),
                        (name, pa.binary() if kind == "binary" else pa.int64())])

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start, n, docs, nulls, lengths, words, escapes, offsets in zip(
                    *(c.to_pylist() for c in b.columns)):
                ids = unpack_words(np.frombuffer(words, "<u8"), np.frombuffer(escapes, "<u8"),
                                   np.frombuffer(offsets, "<i8"), n).astype("<u4").tobytes()
                length = np.frombuffer(lengths, "<i8")
                ends = np.cumsum(length)
                cut = [0, *(4 * ends).tolist()]
                yield pa.RecordBatch.from_arrays([
                    pa.array([None] * nulls + np.frombuffer(docs, "<i8").tolist(), pa.int64()),
                    pa.array(start + ends - length), pa.array(length),
                    pa.array([of(ids[a:z]) for a, z in zip(cut, cut[1:])], schema.field(3).type),
                ], schema=schema)

    return placed.mapInArrow(decode, f"doc_id long, start long, n_tokens long, {last}")
