"""Best-fit packing of tokenised documents into fixed-length sequences (operator 1).

Bounded-space online best fit: a packer holds at most ``open_bins`` open
sequences. Their free spaces are the set bits of one integer, so the fullest
sequence that still takes a piece is one shift and one lowest-set-bit away. If a
piece fits nowhere and all bins are open, the fullest one closes first, as it has
the least left to give.

Documents are tokenised where they lie; only (id, length) rows are shuffled, to
groups of about ``group_docs`` documents by hash. A group is packed alone, so the
work is parallel, memory is bounded by ``open_bins``, and a lost task is repeated
with the same members. Within a group longer pieces arrive first, by ``order``.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parkops.llm.common import id_text, map_rows, tidy
from parkops.llm.words import byte_level, in_batches

SEQ_LEN = 1024
OPEN_BINS = 16_384
GROUP_DOCS = 16_384

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary"
_PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()),
                     ("length", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.binary())])


class BestFit:
    """Online best fit over a bounded number of open bins."""

    def __init__(self, size: int = SEQ_LEN, open_bins: int = OPEN_BINS) -> None:
        self.size, self.open_bins = size, open_bins
        self.free = 0  # bit f: some open bin has f places left
        self.bins: list[list[int]] = [[] for _ in range(size + 1)]
        self.open = self.made = 0

    def place(self, length: int) -> tuple[int, int]:
        """(bin, offset in it) for a piece of 1..size tokens."""
        fits = self.free >> length
        if fits:
            room = length + (fits & -fits).bit_length() - 1
            at = self._take(room)
        else:
            room, at = self.size, self.made
            self.made += 1
            if length < self.size and self.open >= self.open_bins:
                self._take((self.free & -self.free).bit_length() - 1)  # the fullest closes
        left = room - length
        if left:
            self.bins[left].append(at)
            self.free |= 1 << left
            self.open += 1
        return at, self.size - room

    def _take(self, room: int) -> int:
        stack = self.bins[room]
        at = stack.pop()
        if not stack:
            self.free &= ~(1 << room)
        self.open -= 1
        return at


def token_pieces(docs: DataFrame, tokenizer: str, end_id: int = 2, size: int = SEQ_LEN,
                 with_ids: bool = False) -> DataFrame:
    """Ids of every whole text plus the end id, cut into pieces. Only documents of
    more than ``size`` tokens are cut; the first piece takes the remainder, so all
    later ones are full. Null and empty texts give one piece, the end id."""
    end = end_id.to_bytes(4, "little")

    def rows(ids: list, texts: list) -> Iterator[tuple]:
        enc = byte_level(tokenizer)
        for some in in_batches(texts):
            for doc, raw in zip(ids[some], enc.encode_many(texts[some])):
                raw += end
                n = len(raw) // 4
                a, piece, b = 0, 0, (n - 1) % size + 1
                while a < n:
                    part = raw[4 * a:4 * b]
                    yield (doc, piece, a, b - a, zlib.crc32(part), part if with_ids else None)
                    a, b, piece = b, b + size, piece + 1

    return id_text(docs).mapInArrow(map_rows(rows, _PIECES), PIECES)


def pack(docs: DataFrame, tokenizer: str, end_id: int = 2, size: int = SEQ_LEN,
         open_bins: int = OPEN_BINS, group_docs: int = GROUP_DOCS, groups: int | None = None,
         with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset
    (and ids, little-endian u32, if ``with_ids``).

    Pieces of a sequence follow each other without gaps. Repeated doc_ids are packed
    as separate documents; a null doc_id stays null. An empty table gives no rows.
    ``groups``: number of packing groups; by default the document count (a metadata
    read for a table) divided by ``group_docs``.
    """
    pieces = token_pieces(docs, tokenizer, end_id, size, with_ids)
    if groups is None:
        groups = max(1, -(-docs.select("doc_id").count() // group_docs))
    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
    keyed = pieces.select(
        F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(groups)).alias("_group"), *names)
    dealt = keyed.repartition(groups, "_group").sortWithinPartitions(
        "_group", F.desc("length"), "doc_id", "piece", "ids_crc32")
    at = 1 + len(names)
    ddl = (PIECES if with_ids else PIECES.replace(", ids binary", "")) + \
        ", sequence_id long, offset long"
    schema = pa.schema([f for f in _PIECES if f.name in names]
                       + [("sequence_id", pa.int64()), ("offset", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, fit = None, None
        for b in batches:
            out_seq, out_off = [], []
            for g, n in zip(b.column(0).to_pylist(), b.column(4).to_pylist()):
                if g != now:
                    now, fit = g, BestFit(size, open_bins)
                seq, off = fit.place(n)
                out_seq.append(seq * groups + g)
                out_off.append(off)
            yield pa.RecordBatch.from_arrays(
                [*(b.column(i) for i in range(1, at)), pa.array(out_seq, pa.int64()),
                 pa.array(out_off, pa.int64())], schema=schema)

    return dealt.mapInArrow(tidy(run), ddl)
