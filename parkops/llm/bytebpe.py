"""Byte-level BPE over rank files: overlapping-chunk encoding, decoding (operator 2).

A text longer than one chunk is cut into chunks that overlap by ``OVERLAP``
characters; every chunk is pre-tokenised on its own, in any task. The pattern has no
look-behind, so where a chunk and its successor both start a pre-token at the same
place, both go on identically: that place is the stitch. The pieces between stitches
are then encoded in parallel and a document's ids are joined in order. Where an
overlap has no common boundary (one run longer than the overlap), the two chunks'
text is joined and pre-tokenised again. Texts of one chunk need no shuffle.

Decoding concatenates the raw bytes of the ids.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parkops.llm.common import id_text, map_rows, only, to_batch
from parkops.llm.words import u32

CHUNK = 32_768
OVERLAP = 512
MEMO = 300_000

_IDS = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary())])
_CHUNKS = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("chunk", pa.int32()),
                     ("last", pa.bool_()), ("text", pa.string())])
_SPLIT = pa.schema([*_CHUNKS, ("head", pa.binary()), ("tail", pa.binary())])
_PIECES = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("piece", pa.int32()),
                     ("copies", pa.int32()), ("text", pa.string())])
_PIECE_IDS = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("piece", pa.int32()),
                        ("copies", pa.int32()), ("ids", pa.binary())])
_KEYS = "doc_id long, row long, "


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class RankBpe(dict):
    """Ids (little-endian u32 bytes) of a pre-token, kept for the frequent ones."""

    def __init__(self, path: str, pattern: str) -> None:
        import tiktoken
        ranks = load_ranks(path)
        self.enc = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks,
                                     special_tokens={})
        self.pattern = regex.compile(pattern)
        self.raw = [b""] * (max(ranks.values()) + 1)
        for b, i in ranks.items():
            self.raw[i] = b

    def __missing__(self, token: str) -> bytes:
        ids = u32(self.enc.encode_ordinary(token))
        if len(self) < MEMO:
            self[token] = ids
        return ids

    def encode(self, text: str) -> bytes:
        return b"".join([self[t] for t in self.pattern.findall(text)])

    def starts(self, text: str) -> np.ndarray:
        """Where pre-tokens start. All but the last match are the same however the
        text goes on, and so is the start of the last one."""
        n = np.fromiter(map(len, self.pattern.findall(text)), np.int64)
        return np.cumsum(n) - n

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.raw.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def rank_bpe(path: str, pattern: str) -> RankBpe:
    return only(("rank_bpe", path, pattern), lambda: RankBpe(path, pattern))


def encode(docs: DataFrame, ranks: str, pattern: str, chunk: int = CHUNK,
           overlap: int = OVERLAP) -> DataFrame:
    """(doc_id, ids): the whole text's ids as little-endian u32 bytes, no special
    tokens. Null and empty texts: no ids. Repeated doc_ids are encoded each."""
    if not 0 < overlap <= chunk:
        raise ValueError("the overlap must be within a chunk")
    whole = id_text(docs)
    long = F.length("text") > chunk

    def short(ids: list, texts: list) -> Iterator[tuple]:
        bpe = rank_bpe(ranks, pattern)
        return ((i, bpe.encode(t)) for i, t in zip(ids, texts))

    small = whole.filter(~long).mapInArrow(map_rows(short, _IDS, 256), "doc_id long, ids binary")
    return small.unionByName(_long(whole.filter(long), ranks, pattern, chunk, overlap))


def _long(docs: DataFrame, ranks: str, pattern: str, chunk: int, overlap: int) -> DataFrame:
    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for doc, row, text in zip(*(c.to_pylist() for c in b.columns)):
                for k, at in enumerate(range(0, len(text), chunk)):
                    yield to_batch([(doc, row, k, at + chunk >= len(text),
                                     text[at:at + chunk + overlap])], _CHUNKS)

    def presplit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = rank_bpe(ranks, pattern)
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns)):
                at = bpe.starts(row[4])
                tail = at[at >= chunk] - chunk
                yield to_batch([(*row, at[at < overlap].astype("<i4").tobytes(),
                                 tail.astype("<i4").tobytes())], _SPLIT)

    def stitch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = rank_bpe(ranks, pattern)
        key, carry, ends, trusted = None, "", None, True  # what the last chunk left
        for b in batches:
            for doc, row, k, last, text, head, tail in zip(*(c.to_pylist() for c in b.columns)):
                head, tail = np.frombuffer(head, "<i4"), np.frombuffer(tail, "<i4")
                if (doc, row) == key and k == seen:  # a repeated row
                    copies += k == 0
                    continue
                seen = k
                if (doc, row) != key:
                    key, carry, trusted, piece, cut = (doc, row), "", True, 0, 0
                    body, copies = text, 1
                else:
                    both = np.intersect1d(ends, head)
                    if len(both):
                        cut = int(both[0])
                        yield to_batch([(doc, row, piece, copies, carry + text[:cut])], _PIECES)
                        carry, piece, trusted = "", piece + 1, True
                    else:  # nothing to stitch at: go on from the last stitch
                        cut, trusted = 0, False
                    body = text[cut:]
                if last:
                    yield to_batch([(doc, row, piece, copies, carry + body)], _PIECES)
                    continue
                if not trusted:
                    joined = carry + body
                    at = bpe.starts(joined) - (len(joined) - (len(text) - chunk))
                    tail = at[at >= 0]
                ends, carry = tail, carry + text[cut:chunk]

    def piece_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = rank_bpe(ranks, pattern)
        for b in batches:
            for *keys, text in zip(*(c.to_pylist() for c in b.columns)):
                yield to_batch([(*keys, bpe.encode(text))], _PIECE_IDS)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, times, parts = None, 0, []
        for b in batches:
            for doc, row, _, copies, ids in zip(*(c.to_pylist() for c in b.columns)):
                if (doc, row) != key:
                    if parts:
                        yield to_batch([(key[0], b"".join(parts))] * times, _IDS)
                    key, times, parts = (doc, row), copies, []
                parts.append(ids)
        if parts:
            yield to_batch([(key[0], b"".join(parts))] * times, _IDS)

    text_cols = _KEYS + "chunk int, last boolean, text string"
    # the text's hash tells apart rows that share a doc_id; equal rows are counted
    cut = (docs.select("doc_id", F.xxhash64("text").alias("row"), "text")
           .mapInArrow(chunks, text_cols)
           .repartition("doc_id", "row", "chunk")
           .mapInArrow(presplit, text_cols + ", head binary, tail binary"))
    pieces = (cut.repartition("doc_id", "row").sortWithinPartitions("doc_id", "row", "chunk")
              .mapInArrow(stitch, _KEYS + "piece int, copies int, text string"))
    return (pieces.repartition("doc_id", "row", "piece")
            .mapInArrow(piece_ids, _KEYS + "piece int, copies int, ids binary")
            .repartition("doc_id", "row").sortWithinPartitions("doc_id", "row", "piece")
            .mapInArrow(join, "doc_id long, ids binary"))


def decode(encoded: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """(doc_id, bytes): the raw bytes of (doc_id, ids), concatenated."""
    schema = pa.schema([("doc_id", pa.int64()), ("bytes", pa.binary())])

    def rows(docs: list, ids: list) -> Iterator[tuple]:
        bpe = rank_bpe(ranks, pattern)
        return ((d, bpe.decode(i)) for d, i in zip(docs, ids))

    return encoded.mapInArrow(map_rows(rows, schema, 256), "doc_id long, bytes binary")


def digests(encoded: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of (doc_id, ids)."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()),
                        ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    def rows(docs: list, ids: list) -> Iterator[tuple]:
        bpe = rank_bpe(ranks, pattern)
        for d, i in zip(docs, ids):
            yield (d, len(i) // 4, hashlib.sha256(i).hexdigest(),
                   hashlib.sha256(bpe.decode(i)).hexdigest())

    return encoded.mapInArrow(map_rows(rows, schema),
                              "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
