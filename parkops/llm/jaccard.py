"""Similarity join on word shingles with adaptive multi-match prefixes (operator 8).

1. A document's set is its distinct 5-word shingles, hashed to 64 bits. Documents with
   equal sets form a class; only classes are compared.
2. ``blocks.shared_keys`` counts every shingle over all documents. With similarity 0.8 or
   more to anything, 80 % of a document's shingles occur elsewhere too; classes below
   that are done.
3. Shingles are ordered by count, rare ones first. Similar sets share at least l tokens of
   their l-prefixes (size - required overlap + l tokens). Each class picks the l whose
   estimated candidate cost, from the counts, is least; a pair has to share as many
   prefix tokens as the smaller of their l before it is verified on the whole sets.
4. Classes that share a token of their 1-prefixes, directly or through others, form a
   cluster; no link leaves one. Clusters are searched breadth first: an expanded class is
   compared with classes not reached yet, so a group of n near copies costs about n
   comparisons, not n squared, and pairs are never emitted, only a spanning forest.
   Clusters too large for a task first lose the surroundings of hubs that, by the
   triangle inequality of Jaccard distance, can't link to anything outside, and what is
   still too large is compared in pairs of bounded parts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parkops.llm.blocks import Block, in_blocks, joined, shared_keys
from parkops.llm.common import NULL_ID, release, tidy, to_batch, written
from parkops.llm.components import components

WORDS = 5
PERCENT = 80
MAX_L = 8
#: Shingles of one task's classes, about.
TASK_TOKENS = 2_000_000
PEEL_ROUNDS = 4
SEGMENT = 1 << 20

_C = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.zeros(256, bool)
_BLANK[[32, *range(9, 14)]] = True
_BYTE = np.array([int.from_bytes(xxhash.xxh64_digest(bytes([i])), "little") for i in range(256)],
                 np.uint64)
_BASE = np.uint64(0xD6E8FEB86659FD93)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _C[1]
    return (h ^ (h >> np.uint64(29))) * _C[2]


def word_hashes(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, its document) in order; words are runs of bytes that are not
    blank, with A-Z in lower case."""
    data, n = block.data, len(block.data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    blank = _BLANK[data]
    edge = np.zeros(n + 1, bool)  # a document starts here
    edge[block.starts] = True
    start = np.flatnonzero(~blank & (np.r_[True, blank[:-1]] | edge[:n]))
    stop = np.flatnonzero(~blank & (np.r_[blank[1:], True] | edge[1:])) + 1
    doc = np.searchsorted(block.ends, start, side="right")
    out = np.empty(len(start), np.uint64)
    i = 0
    while i < len(start):  # memory stays bounded in very long texts
        j = max(i + 1, int(np.searchsorted(start, start[i] + SEGMENT)))
        a, z = start[i], stop[j - 1]
        power = np.full(z - a, _BASE)
        power[0] = 1
        back = np.full(z - a, _INVERSE)
        back[0] = 1
        np.multiply.accumulate(power, out=power)
        np.multiply.accumulate(back, out=back)
        sums = np.cumsum(_BYTE[_LOWER[data[a:z]]] * power)
        s, e = start[i:j] - a, stop[i:j] - a
        h = (sums[e - 1] - np.where(s > 0, sums[s - 1], np.uint64(0))) * back[s]
        out[i:j] = _mix(h + (e - s).astype(np.uint64) * _C[0])
        i = j
    return out, doc


class Sets:
    """Sorted distinct shingles of each document of a block, one after the other."""

    def __init__(self, block: Block, words: int = WORDS) -> None:
        w, doc = word_hashes(block)
        many = len(block.docs)
        count = np.bincount(doc, minlength=many)
        first = np.cumsum(count) - count
        size = np.where(count >= words, count - words + 1, np.minimum(count, 1))
        at = np.repeat(first - (np.cumsum(size) - size), size) + np.arange(size.sum())
        of = np.repeat(np.arange(many), size)
        h = np.repeat(np.minimum(count, words).astype(np.uint64), size) * _C[0]
        for j in range(words):  # a shorter text is one shingle of all its words
            has = at + j < (first + count)[of]
            part = w[np.minimum(at + j, len(w) - 1)] if len(w) else w
            h = np.where(has, _mix(h ^ part) + _C[0], h)
        cut = np.cumsum(np.r_[0, size])
        for a, z in zip(cut[:-1].tolist(), cut[1:].tolist()):
            h[a:z].sort()
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (of[1:] != of[:-1])
        self.keys = h[new]
        self.size = np.bincount(of[new], minlength=many)
        self.cut = np.cumsum(np.r_[0, self.size])
        self.docs = block.docs
        self.classes = [xxhash.xxh3_128_digest(self.keys[a:z].tobytes()) if z > a else None
                        for a, z in zip(self.cut[:-1].tolist(), self.cut[1:].tolist())]
        # of equal sets the smallest doc_id stands for all
        best: dict[bytes, int] = {}
        for i, c in enumerate(self.classes):
            if c is not None and (c not in best or self.docs[i] < self.docs[best[c]]):
                best[c] = i
        self.first = sorted(best.values())

    def of(self, i: int) -> np.ndarray:
        return self.keys[self.cut[i]:self.cut[i + 1]]

    def distinct(self) -> tuple[np.ndarray, np.ndarray]:
        """(sorted distinct shingles, classes of the block that have each)."""
        if not self.first:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        return np.unique(np.concatenate([self.of(i) for i in self.first]), return_counts=True)


def required(size, percent: int = PERCENT):
    """The least overlap of a set with any set that it links to."""
    return -(-size * percent // 100)


def choose_l(counts: np.ndarray, base: int, max_l: int = MAX_L) -> int:
    """The l with the least estimated cost: tokens looked up in the l-prefix, by their
    counts, and the candidates among them that share l tokens, at several times the
    price. ``base``: tokens of the 1-prefix that occur elsewhere."""
    best, least = 1, None
    sums = np.cumsum(counts[:base + max_l - 1].astype(np.float64))
    for l in range(1, min(max_l, len(counts) - base + 1) + 1):
        cost = sums[base + l - 2] * (1 + 8 / l)
        if least is None or cost < least:
            best, least = l, cost
    return best


_INFO = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("class", pa.binary()),
                   ("node", pa.int64()), ("l", pa.int32()), ("base", pa.int32()),
                   ("tokens", pa.binary())])
INFO = "doc_id long, n long, class binary, node long, l int, base int, tokens binary"


def join(docs: DataFrame, percent: int = PERCENT, words: int = WORDS,
         task_tokens: int = TASK_TOKENS) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id (the smallest doc_id reachable by
    links, itself included).

    Texts without words have no shingles and link to nothing. Rows that share a doc_id
    are compared like any others. A null doc_id counts as larger than all others and is
    returned as null, as is the component of such documents alone. Sets are compared by
    64-bit shingle hashes and classes by 128-bit hashes.
    """
    def keys(block: Block, extra: bytes) -> tuple[np.ndarray, np.ndarray]:
        return Sets(block, words).distinct()

    def count(block: Block) -> tuple[bytes, int]:
        return b"", int(_BLANK[block.data].sum()) + len(block.docs)

    table = in_blocks(docs, [], count)
    total = table.agg(F.sum("n_keys")).first()[0] or 0
    counts = shared_keys(table, keys, total)

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for docs, lengths, data, counts in zip(*(c.to_pylist() for c in b.columns)):
                sets = Sets(Block(docs, lengths, data), words)
                every, _ = sets.distinct()
                times = joined(counts, "<u2")
                stands, out = set(sets.first), []
                for i, name in enumerate(sets.classes):
                    n = int(sets.size[i])
                    row = [int(sets.docs[i]), n, name,
                           int.from_bytes(name[:8], "little", signed=True) if name else None,
                           None, None, None]
                    if i in stands:
                        own = sets.of(i)
                        t = times[np.searchsorted(every, own)]
                        several = t >= 2
                        m, least = int(several.sum()), required(n, percent)
                        if m >= least:
                            own, t = own[several], t[several]
                            order = np.lexsort((own, t))
                            base = (n - least + 1) - (n - m)
                            row[4:] = [choose_l(t[order], base), base, own[order].tobytes()]
                    out.append(tuple(row))
                yield to_batch(out, _INFO)

    info = written(table.select("block", "docs", "lengths", "data").join(counts, "block", "left")
                   .select("docs", "lengths", "data", "counts").mapInArrow(tidy(describe), INFO), "sets")
    classes = info.filter("class is not null").groupBy("class").agg(
        F.min("doc_id").alias("rep"), F.min("node").alias("node"))
    # a class is compared once, by the row of its smallest document
    active = info.filter("tokens is not null").select(
        "node", "doc_id", "class", "n", "l", "base", "tokens")
    active = written(active.join(classes.select("class", "rep"), "class")
                     .filter(F.col("doc_id") == F.col("rep")).drop("class", "doc_id", "rep")
                     .dropDuplicates(["node"]), "classes")
    links = _links(active, percent, task_tokens)
    label = components(links)
    named = classes.select("class", "rep", "node").join(label, "node", "left") \
        .withColumn("root", F.coalesce("root", "node"))
    least = named.groupBy("root").agg(F.min("rep").alias("component"))
    found = named.join(least, "root").select("class", "component")
    rows = info.select("doc_id", "n", "class")
    id_of = lambda c: F.when(F.col(c) != NULL_ID, F.col(c))
    linked = rows.filter("class is not null").join(found, "class")
    alone = rows.filter("class is null").withColumn("component", F.col("doc_id"))
    return linked.unionByName(alone).select(
        id_of("doc_id").alias("doc_id"), F.col("n").alias("n_shingles"),
        id_of("component").alias("component_id"))


def _links(active: DataFrame, percent: int, task_tokens: int) -> DataFrame:
    """(a, b): links that connect the same classes as all links do."""
    schema = pa.schema([("node", pa.int64()), ("token", pa.int64())])

    def prefix(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for node, base, tokens in zip(*(c.to_pylist() for c in b.columns)):
                t = np.frombuffer(tokens, "<i8")[:base]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(t), node)), pa.array(t)], schema=schema)

    shared = active.select("node", "base", "tokens").mapInArrow(prefix, "node long, token long")
    shared = written(shared, "prefixes")
    hubs = shared.groupBy("token").agg(F.min("node").alias("hub"), F.max("node").alias("other")) \
        .filter("hub != other").select("token", "hub")
    stars = shared.join(hubs, "token").filter("node != hub") \
        .select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct()
    cluster = components(stars).select("node", F.col("root").alias("cluster"))
    rows = written(active.join(cluster, "node"), "clustered")
    peeled = []
    for _ in range(PEEL_ROUNDS):
        large = _sizes(rows, task_tokens).filter("parts > 1").select("cluster")
        if large.isEmpty():
            break
        rows, links = _peel(rows, large, percent)
        peeled.append(links)
    tasks = _sizes(rows, task_tokens)
    everything = rows.agg(F.sum(F.length("tokens"))).first()[0] or 0
    spread = max(1, -(-everything // (8 * task_tokens)), min(64, everything // 400_000))
    # a small cluster goes to one task with others, a large one to pairs of its parts
    part = F.pmod(F.xxhash64("node", F.lit(7)), F.col("parts"))
    dealt = rows.join(tasks, "cluster").withColumn("part", part).select(
        "node", "n", "l", "base", "tokens",
        F.when(F.col("parts") == 1, F.lit(0)).otherwise(F.col("cluster")).alias("of"),
        F.explode(F.when(F.col("parts") == 1, F.array(
            F.struct(F.pmod(F.xxhash64("cluster"), F.lit(spread)).alias("i"),
                     F.lit(0).cast("long").alias("j")))).otherwise(
            F.transform(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1),
                        lambda k: F.struct(F.least(k, "part").alias("i"),
                                           F.greatest(k, "part").alias("j"))))).alias("t"))

    def search(group: pa.Table) -> pa.Table:
        a, b = forest(group.column("node").to_numpy(), group.column("n").to_numpy(),
                      group.column("l").to_numpy(), group.column("base").to_numpy(),
                      [np.frombuffer(t, "<u8") for t in group.column("tokens").to_pylist()], percent)
        release()
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    out = dealt.select("node", "n", "l", "base", "tokens", "of", "t.i", "t.j") \
        .groupBy("of", "i", "j").applyInArrow(search, "a long, b long")
    for links in peeled:
        out = out.unionByName(links)
    return out


def _sizes(rows: DataFrame, task_tokens: int) -> DataFrame:
    """(cluster, parts): into how many parts each cluster has to be cut for a task."""
    return rows.groupBy("cluster").agg(F.ceil(
        F.sum(F.length("tokens")) / F.lit(8.0 * task_tokens)).alias("parts"))


def _peel(rows: DataFrame, large: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """One hub per large cluster: (rows left, links to the hubs).

    With d the Jaccard distance, no a linked to the hub h can link to an outside b if
    d(a, h) < d(b, h) - (1 - percent / 100); such a are done once tied to the hub."""
    big = rows.join(large, "cluster", "left_semi")
    hub = big.groupBy("cluster").agg(F.min_by(
        F.struct("node", "n", "tokens"), F.struct(F.xxhash64("node"), "node")).alias("h"))
    schema = pa.schema([("cluster", pa.int64()), ("node", pa.int64()), ("hub", pa.int64()),
                        ("common", pa.int64()), ("either", pa.int64())])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for cluster, node, n, tokens, name, m, own in zip(*(c.to_pylist() for c in b.columns)):
                both = len(np.intersect1d(np.frombuffer(tokens, "<u8"), np.frombuffer(own, "<u8"),
                                          assume_unique=True))
                out.append((cluster, node, name, n if node == name else both,
                            n if node == name else n + m - both))
            yield to_batch(out, schema)

    met = written(big.join(hub, "cluster").select(
        "cluster", "node", "n", "tokens", F.col("h.node").alias("hub"), F.col("h.n").alias("m"),
        F.col("h.tokens").alias("own"))
        .mapInArrow(compare, "cluster long, node long, hub long, common long, either long"), "hubs")
    near = F.col("common") * 100 >= F.col("either") * percent
    far = 1 - F.col("common") / F.col("either")
    outside = met.filter(~near).groupBy("cluster").agg(F.min(far).alias("_out"))
    done = met.filter(near).join(outside, "cluster", "left").filter(
        F.col("_out").isNull() | (far < F.col("_out") - (1 - percent / 100) - 1e-9)
        | (F.col("node") == F.col("hub"))).select("node")
    links = met.filter(near & (F.col("node") != F.col("hub"))).select(
        F.col("node").alias("a"), F.col("hub").alias("b"))
    return written(rows.join(done, "node", "left_anti"), "clustered"), links


def forest(node: np.ndarray, n: np.ndarray, l: np.ndarray, base: np.ndarray,
           tokens: list[np.ndarray], percent: int) -> tuple[list[int], list[int]]:
    """Links of a spanning forest of the similarity graph over whole sets."""
    many = len(node)
    prefix = [t[:b + x - 1] for t, b, x in zip(tokens, base.tolist(), l.tolist())]
    inverse = np.unique(np.concatenate(prefix), return_inverse=True)[1]
    cut = np.cumsum([0, *map(len, prefix)])
    ordered = [np.sort(t) for t in tokens]
    size = np.array([len(t) for t in tokens])
    waiting = np.ones(many, bool)
    index = _index(inverse, cut, waiting)
    indexed = many
    a, b = [], []
    left = many
    for seed in range(many):
        if not waiting[seed]:
            continue
        waiting[seed] = False
        left -= 1
        todo = [seed]
        while todo and left:
            x = todo.pop()
            if left < indexed // 2:  # forget classes that were reached
                index, indexed = _index(inverse, cut, waiting), left
            start, doc = index
            own = inverse[cut[x]:cut[x + 1]]
            s, e = start[own], start[own + 1]
            length = e - s
            if not length.sum():
                continue
            at = np.repeat(s - (np.cumsum(length) - length), length) + np.arange(length.sum())
            seen, shared = np.unique(doc[at], return_counts=True)
            ok = waiting[seen] & (shared >= np.minimum(l[x], l[seen])) \
                & (100 * n[seen] >= percent * n[x]) & (100 * n[x] >= percent * n[seen])
            seen = seen[ok]
            if not len(seen):
                continue
            every = np.concatenate([ordered[y] for y in seen.tolist()])
            mine = ordered[x]
            hit = mine[np.minimum(np.searchsorted(mine, every), len(mine) - 1)] == every
            common = np.add.reduceat(hit, np.cumsum(size[seen]) - size[seen])
            linked = seen[100 * common >= percent * (n[x] + n[seen] - common)]
            for y in linked.tolist():
                waiting[y] = False
                a.append(int(node[x]))
                b.append(int(node[y]))
                todo.append(y)
            left -= len(linked)
    return a, b


def _index(inverse: np.ndarray, cut: np.ndarray, waiting: np.ndarray) -> tuple:
    """Inverted index of the prefixes of the classes not reached yet."""
    doc = np.repeat(np.arange(len(cut) - 1), np.diff(cut))
    keep = waiting[doc]
    tok, doc = inverse[keep], doc[keep]
    order = np.argsort(tok, kind="stable")
    start = np.zeros((int(inverse.max()) if len(inverse) else 0) + 2, np.int64)
    np.add.at(start, tok + 1, 1)
    return np.cumsum(start), doc[order]
