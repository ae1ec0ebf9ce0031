"""Spelling variant grouping by PartEnum signatures (operator 13).

Words are counted over all texts. A word's letters with their occurrence numbers (the
second ``e`` is another element than the first) make a set, a binary vector. One inserted,
deleted or replaced letter changes at most two elements, so near words lie at Hamming
distance two at most. PartEnum: the dimensions are partitioned into ``PARTS`` classes by a
hash; whichever two elements differ, they lie in at most two classes, so for some choice
of two classes the vectors agree on all others. A word has one signature for each choice:
the hash of its length and of its elements in the other classes. Words of lengths l and
l + 1 differ in one element only, so there the choice is of one class, and the signature
holds the smaller length. Words with a common signature are found by an equi-join, and
each such pair is verified by its edit distance.

Signatures are hashes, which can only add candidates; the verification is exact.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parkops.llm.common import id_text, small_batches, tidy, to_batch, written

MIN_LENGTH, MIN_COUNT, ONE_IN = 6, 5, 199
#: A form has so many times its word's occurrences at least.
RATIO = 5
#: Classes of the letters' partition; at most two of them are left out of a signature.
PARTS = 8
#: Bytes of a text cut into runs at once, and different words counted before they are sent on.
SLICE, HELD = 1 << 20, 200_000

# Latin-1 bytes of runs, A-Z lower-cased; every other byte ends a run.
_RUN = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 0xC0 else 32 for c in range(256))
_WORDS = pa.schema([("word", pa.string()), ("n", pa.int64())])
_SIGNS = pa.schema([("word", pa.string()), ("signs", pa.list_(pa.int64()))])


def _runs(text: str) -> Counter:
    """Lower-cased runs of a text with their numbers, as Latin-1 bytes. Code points beyond
    Latin-1 become '?', which ends a run as they do."""
    data = text.encode("latin-1", "replace").translate(_RUN)
    if len(data) <= SLICE:
        return Counter(data.split())
    found, at = Counter(), 0
    while at < len(data):
        end = data.find(b" ", at + SLICE)
        end = len(data) if end < 0 else end
        found.update(data[at:end].split())
        at = end
    return found


def _result(run: bytes, prefix_crc: int) -> bytes:
    """The run, without one letter if 199 divides the hash of its document and itself."""
    plain = run if run.isascii() else run.decode("latin-1").encode()
    h = zlib.crc32(plain, prefix_crc)
    if h % ONE_IN:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1:]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[bytes, int] = {}

    def send() -> Iterator[pa.RecordBatch]:
        rows = [(w.decode("latin-1"), n) for w, n in total.items()]
        total.clear()
        for i in range(0, len(rows), 20_000):
            yield to_batch(rows[i:i + 20_000], _WORDS)

    for b in batches:
        for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            prefix = zlib.crc32(f"{doc}:".encode())
            for run, n in _runs(text).items():
                if len(run) >= MIN_LENGTH:
                    word = _result(run, prefix)
                    if len(word) >= MIN_LENGTH:
                        total[word] = total.get(word, 0) + n
            if len(total) >= HELD:
                yield from send()
    yield from send()


def words(docs: DataFrame, min_count: int = MIN_COUNT) -> DataFrame:
    """(word, n): the words of all texts with at least ``min_count`` occurrences."""
    docs = id_text(docs).withColumn("doc_id", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))
    return (docs.mapInArrow(tidy(_count), "word string, n long")
            .groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count))


_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit hash of numbers, modulo 2**64 (the finisher of splitmix64)."""
    x = x * _U(0x9E3779B97F4A7C15) + _U(0x632BE59BD9B4E019)
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def signatures(words_: list[str], longer: bool, parts: int = PARTS) -> np.ndarray:
    """A row of signatures per word: for every two classes left out, those by which it
    meets words as long as itself; for every one left out, those by which it meets words
    with one letter more or, as the ``longer`` one, with one letter less."""
    lengths = np.array([len(w) for w in words_])
    letters = np.array([ord(c) for w in words_ for c in w], np.uint64)
    owner = np.repeat(np.arange(len(words_)), lengths)
    # number of earlier occurrences of the same letter in the word
    order = np.lexsort((letters, owner))
    o, c = owner[order], letters[order]
    first = np.r_[True, (o[1:] != o[:-1]) | (c[1:] != c[:-1])]
    nth = np.arange(len(o)) - np.flatnonzero(first)[np.cumsum(first) - 1]
    element = _mix(c * _U(1 << 32) + nth.astype(np.uint64))
    sums = np.zeros((len(words_), parts), np.uint64)
    np.add.at(sums, (o, (element % _U(parts)).astype(np.int64)), _mix(element))
    whole, size = sums.sum(1), lengths.astype(np.uint64)
    out = [_mix(_mix(whole - sums[:, i] - sums[:, j]) + size * _U(4096) + _U(i * parts + j))
           for i, j in combinations(range(parts), 2)]
    less = size - _U(1) if longer else size
    out += [_mix(_mix(whole - sums[:, i]) + less * _U(4096) + _U(parts * parts + i))
            for i in range(parts)]
    return np.stack(out, 1).view(np.int64)


def _signed(longer: bool, parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 4096):
                ws = b.column(0).slice(i, 4096)
                found = signatures(ws.to_pylist(), longer, parts)
                ends = np.arange(0, found.size + 1, found.shape[1], dtype=np.int32)
                yield pa.RecordBatch.from_arrays(
                    [ws.cast(pa.string()), pa.ListArray.from_arrays(ends, found.ravel())], schema=_SIGNS)
    return tidy(run)


def near_pairs(counted: DataFrame, parts: int = PARTS) -> DataFrame:
    """(a, b) of a column word: every two different words at edit distance one, once (the
    shorter first, of equally long ones the smaller)."""
    small_batches(counted.sparkSession)
    sides = [counted.select("word").mapInArrow(_signed(longer, parts), "word string, signs array<long>")
             .select(F.explode("signs").alias("sign"), F.col("word").alias(name))
             for longer, name in ((False, "a"), (True, "b"))]
    more = F.length("b") - F.length("a")
    # Spark sizes a word's exploded signatures as one row, and would broadcast them: ruled out
    return (sides[0].join(sides[1].hint("merge"), "sign")
            .filter(((more == 1) | ((more == 0) & (F.col("a") < F.col("b"))))
                    & (F.expr("levenshtein(a, b, 1)") == 1))
            .select("a", "b").distinct())


def variants(docs: DataFrame, min_count: int = MIN_COUNT, parts: int = PARTS) -> DataFrame:
    """Per word: word, n, n_near, form, form_n, root.

    Null texts have no words; a null doc_id is hashed as ``null``; repeated rows count
    again. Other columns are not read. A form has at least ``RATIO`` times its word's
    occurrences, so a chain of forms has at most 27 links (64-bit counts) and five
    doublings of the links reach every root. Joins are merged: files of words are much smaller
    than what a broadcast of them holds.
    """
    counted = written(words(docs, min_count), "spelling-words")
    pairs = written(near_pairs(counted, parts), "spelling-pairs")
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("other")).unionAll(pairs.select("b", "a")) \
        .join(counted.select(F.col("word").alias("other"), F.col("n").alias("on")).hint("merge"), "other")
    near = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"),
                                    F.min(F.struct((-F.col("on")).alias("m"), "other")).alias("best"))
    enough = -F.col("best.m") >= RATIO * F.col("n")
    formed = written(counted.join(near.hint("merge"), "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(enough, F.col("best.other")).alias("form"),
        F.when(enough, -F.col("best.m")).cast("long").alias("form_n")), "spelling-forms")
    links = formed.filter("form is not null").select("word", F.col("form").alias("root"))
    for _ in range(5):
        nxt = links.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        doubled = written(links.join(nxt.hint("merge"), "root", "left").select(
            "word", F.coalesce("_next", "root").alias("root"),
            F.col("_next").isNotNull().alias("_moved")), "spelling-links")
        links = doubled.select("word", "root")
        if doubled.filter("_moved").limit(1).count() == 0:
            break
    return formed.join(links.hint("merge"), "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
