"""Ranked lexical search by multi-query common-subexpression evaluation (operator 11).

Many items are evaluated together. Terms that the same items hold equally often form a
class, evaluated as one. Among the items' classes, pairs shared by several items are mined
in rounds: the most shared pairs become nodes, which take the pairs' place in the items and
can be paired again. The result is a DAG from terms over shared sets to items. For every
document the partial sums of its terms' scores are accumulated once in each class and each
shared node and passed on along the DAG, so what items have in common is added up once.
Only nodes that a document reaches are touched.

Items are a stated query set: they are taken in blocks of about ``BLOCK_BYTES`` of text,
whose terms and DAG have a bounded size and go to the tasks; documents are read once per
block for its terms' counts. A task keeps an item's ``k`` best documents; these are merged
in two steps.
"""

from __future__ import annotations

import math
import pickle
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parkops.llm.common import NULL_ID, id_text, small_batches, tidy, to_batch, written

BLOCK_BYTES = 2 << 20
TOP = 20
#: Classes next to each other (by number of items) that are tried as pairs; rounds of mining.
NEIGHBOURS, ROUNDS = 6, 8
#: Bytes of a text cut into terms at once; documents scored together; results held.
SLICE, DOCS, HELD = 1 << 20, 256, 200_000

# Bytes of terms: letters, digits and all beyond ASCII; A-Z lower-cased, others end a term.
_TERM = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32
              for c in range(256))
_PLANS = pa.schema([("block", pa.int64()), ("plan", pa.binary())])
_POSTINGS = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()),
                       ("terms", pa.list_(pa.int32())), ("tfs", pa.list_(pa.int64()))])
_FOUND = pa.schema([("item", pa.int64()), ("item_id", pa.int64()), ("doc_id", pa.int64()),
                    ("score", pa.int64())])


def terms(text: str) -> tuple[int, Counter]:
    """(number of terms, term bytes -> occurrences) of a whole text."""
    data = text.encode("utf-8", "replace").translate(_TERM)
    found, at, n = Counter(), 0, 0
    while at < len(data):
        end = data.find(b" ", at + SLICE)
        end = len(data) if end < 0 else end
        cut = data[at:end].split()
        n += len(cut)
        found.update(cut)
        at = end
    return n, found


def mine(items: list[dict[bytes, int]]) -> dict:
    """The evaluation plan of items (term -> occurrences): the terms in order; the class of
    each; edges (from, to, times) by the level of their start; nodes 0.. with the items
    last, item i as node ``first_item`` + i."""
    holders: dict[bytes, list] = {}
    for i, item in enumerate(items):
        for t, times in item.items():
            holders.setdefault(t, []).append((i, times))
    vocabulary = sorted(holders)
    classes: dict[tuple, int] = {}
    class_of = [classes.setdefault(tuple(holders[t]), len(classes)) for t in vocabulary]
    needs: list[list] = [[] for _ in items]      # per item: (node, times)
    for held, node in classes.items():
        for i, times in held:
            needs[i].append((node, times))
    level, parts, n = dict.fromkeys(range(len(classes)), 0), {}, len(classes)
    for _ in range(ROUNDS):
        shared = Counter(x for xs in needs for x in xs)
        pairs: Counter = Counter()
        for xs in needs:
            xs.sort(key=lambda x: (-shared[x], x))
            for at, x in enumerate(xs):
                if shared[x] > 1:
                    pairs.update((x, y) for y in xs[at + 1:at + 1 + NEIGHBOURS]
                                 if shared[y] > 1 and x[1] == y[1])
        made: dict[tuple, int] = {}
        for xs in needs:
            seen = sorted(((-pairs[p], p) for p in
                           ((x, y) for at, x in enumerate(xs) for y in xs[at + 1:at + 1 + NEIGHBOURS])
                           if pairs.get(p, 0) > 1))
            used: set = set()
            for _, (x, y) in seen:
                if x not in used and y not in used:
                    used |= {x, y}
                    key = (x[0], y[0])
                    if key not in made:
                        made[key] = n
                        level[n] = max(level[x[0]], level[y[0]]) + 1
                        parts[n] = key
                        n += 1
                    xs.append((made[key], x[1]))
            xs[:] = [x for x in xs if x not in used]
        if not made:
            break
    top = max(level.values(), default=0) + 1
    edges: dict[int, list] = {}
    for node, (x, y) in parts.items():
        for part in (x, y):
            edges.setdefault(level[part], []).append((part, node, 1))
    for i, xs in enumerate(needs):
        for node, times in xs:
            edges.setdefault(level[node], []).append((node, n + i, times))
    by_level = []
    for lv in range(top):
        e = np.array(sorted(edges.get(lv, [])), np.int64).reshape(-1, 3)
        by_level.append((e[:, 0].copy(), e[:, 1].copy(), e[:, 2].copy()))
    return {"terms": vocabulary, "class_of": np.array(class_of, np.int64), "edges": by_level,
            "first_item": n, "items": len(items)}


def _mined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One block's items (block, item_id, text) to its plan."""
    block, ids, items = None, [], []
    for b in batches:
        for block, item_id, text in zip(*(c.to_pylist() for c in b.columns)):
            found = terms(text)[1]
            if found:
                ids.append(item_id)
                items.append(dict(found))
    order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0))
    plan = mine([items[i] for i in order]) | {"ids": [ids[i] for i in order]}
    yield to_batch([(block, pickle.dumps(plan))], _PLANS)


def plans(items: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(block, plan): the items in blocks by a hash of id and text, each with its DAG."""
    rows = items.select(F.col("item_id").cast("long").alias("item_id"),
                        F.coalesce("text", F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    return written(rows.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)))
                   .select("block", "item_id", "text").groupBy("block")
                   .applyInArrow(_whole(_mined), "block long, plan binary"), "lexical-plans")


def _whole(fn):
    """A function of a group given as one table, from one of batches."""
    def run(table: pa.Table) -> pa.Table:
        return pa.Table.from_batches(list(fn(iter(table.to_batches()))))
    return run


def _postings(vocabulary: list[bytes]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = {t: i for i, t in enumerate(vocabulary)}
        out: list[tuple] = []
        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                n, found = terms(text)
                if n:
                    hits = [(at[t], tf) for t, tf in found.items() if t in at]
                    out.append((doc_id, n, [t for t, _ in hits], [tf for _, tf in hits]))
                if len(out) >= 1024:
                    yield to_batch(out, _POSTINGS)
                    out = []
        if out:
            yield to_batch(out, _POSTINGS)
    return tidy(run)


def best(item: np.ndarray, doc: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Indexes of each item's k highest scores, ties to smaller docs."""
    order = np.lexsort((doc, -score, item))
    i = item[order]
    first = np.r_[True, i[1:] != i[:-1]] if len(i) else np.zeros(0, bool)
    nth = np.arange(len(i)) - np.flatnonzero(first)[np.cumsum(first) - 1] if len(i) else i
    return order[nth < k]


def evaluate(plan: dict, weight: np.ndarray, doc: np.ndarray, term: np.ndarray, part: np.ndarray,
             docs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(item, doc, score) of some documents: ``part`` holds the unweighted share of each
    (doc, term). Accumulators of (node, doc) are summed level by level along the DAG."""
    waiting: dict[int, list] = {0: [(plan["class_of"][term] * docs + doc, weight[term] * part)]}
    level_of = plan["level_of"]
    for lv, (start, to, times) in enumerate(plan["edges"]):
        if lv not in waiting:
            continue
        key, acc = _summed(waiting.pop(lv))
        node, d = key // docs, key % docs
        lo, hi = np.searchsorted(start, node, "left"), np.searchsorted(start, node, "right")
        n = hi - lo
        edge = np.repeat(hi - np.cumsum(n), n) + np.arange(n.sum())
        target = to[edge]
        values = np.repeat(acc, n) * times[edge]
        keys = target * docs + np.repeat(d, n)
        for up in np.unique(level_of[target]):
            mine_ = level_of[target] == up
            waiting.setdefault(int(up), []).append((keys[mine_], values[mine_]))
    done = waiting.pop(len(plan["edges"]), None)
    if not done:
        return (np.zeros(0, np.int64),) * 3
    key, acc = _summed(done)
    return key // docs - plan["first_item"], key % docs, acc


def _summed(parts: list) -> tuple[np.ndarray, np.ndarray]:
    key = np.concatenate([k for k, _ in parts])
    value = np.concatenate([v for _, v in parts])
    order = np.argsort(key, kind="stable")
    key, value = key[order], value[order]
    if not len(key):
        return key, value
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    return key[first], np.add.reduceat(value, first)


def with_levels(plan: dict) -> dict:
    """The plan with each node's level; items are on the last one."""
    level_of = np.full(plan["first_item"] + plan["items"], len(plan["edges"]), np.int64)
    for lv, (start, _, _) in enumerate(plan["edges"]):
        level_of[start] = lv
    return plan | {"level_of": level_of}


def _scored(plan: dict, weight: np.ndarray, n_docs: int, n_terms: int, k: int):
    item_ids = pa.array(plan["ids"], pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        item, ids, score = (np.zeros(0, np.int64) for _ in range(3))
        held: list[tuple] = []
        count = 0

        def keep():
            nonlocal item, ids, score, held, count
            item, ids, score = (np.concatenate([a, *(h[j] for h in held)])
                                for j, a in enumerate((item, ids, score)))
            top = best(item, ids, score, k)
            item, ids, score, held, count = item[top], ids[top], score[top], [], 0

        for b in batches:
            for at in range(0, b.num_rows, DOCS):
                part = b.slice(at, DOCS)
                doc_id = part.column(0).fill_null(NULL_ID).to_numpy()
                n = part.column(1).to_numpy()
                lists = part.column(2)
                sizes = np.diff(lists.offsets.to_numpy())
                term = lists.flatten().to_numpy().astype(np.int64)
                tf = part.column(3).flatten().to_numpy()
                doc = np.repeat(np.arange(part.num_rows), sizes)
                m = 100 - 25 + (25 * n * n_docs) // n_terms
                share = (1_000_000_000 * tf) // (1000 * tf + 12 * m[doc])
                found = evaluate(plan, weight, doc, term, share, part.num_rows)
                good = found[2] > 0
                held.append((found[0][good], doc_id[found[1][good]], found[2][good]))
                count += int(good.sum())
                if count >= HELD:
                    keep()
        keep()
        for at in range(0, len(item), 10_000):
            d = ids[at:at + 10_000]
            yield pa.RecordBatch.from_arrays(
                [pa.array(item[at:at + 10_000]), item_ids.take(pa.array(item[at:at + 10_000])),
                 pa.array(d, mask=d == NULL_ID),
                 pa.array(score[at:at + 10_000])], schema=_FOUND)
    return tidy(run)


def search(items: DataFrame, docs: DataFrame, k: int = TOP, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's k best documents with a score above 0.

    Every row of ``items`` is ranked for itself, also if ids repeat or are null; items
    without terms have no results. Null texts have no terms. Equal scores go by ascending
    doc_id, null ids last. Other columns are not read. Arithmetic is exact
    while 25 x a document's terms x the documents is below 2^63.
    """
    spark = items.sparkSession
    small_batches(spark)
    docs, found = id_text(docs), []
    made = plans(items, block_bytes)
    for (block,) in made.select("block").toLocalIterator():
        plan = with_levels(pickle.loads(made.filter(F.col("block") == block).first()["plan"]))
        postings = written(docs.mapInArrow(_postings(plan["terms"]),
                                           "doc_id long, n long, terms array<int>, tfs array<long>"),
                           "lexical-postings")
        n_docs, n_terms = postings.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
        weight = np.zeros(len(plan["terms"]), np.int64)
        # one row per term of the block, which is bounded
        for t, df in (postings.select(F.explode("terms").alias("t")).groupBy("t").count()).toLocalIterator():
            weight[t] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))
        top = postings.filter(F.size("terms") > 0).mapInArrow(
            _scored({x: plan[x] for x in ("ids", "class_of", "edges", "first_item", "level_of")},
                    weight, n_docs, max(1, n_terms), k), "item long, item_id long, doc_id long, score long")
        found.append(_merge(top, k).select("item_id", "rank", "doc_id", "score"))
    if not found:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    return reduce(DataFrame.unionAll, found)


def _merge(top: DataFrame, k: int) -> DataFrame:
    """The k best of each item from the tasks' best: first within parts of the documents."""
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    parts = max(1, math.isqrt(top.sparkSession.sparkContext.defaultParallelism * 16))
    some = Window.partitionBy("item", "_part").orderBy(*order)
    every = Window.partitionBy("item").orderBy(*order)
    return (top.withColumn("_part", F.pmod(F.xxhash64("doc_id", "score"), F.lit(parts)))
            .withColumn("rank", F.row_number().over(some)).filter(F.col("rank") <= k)
            .withColumn("rank", F.row_number().over(every)).filter(F.col("rank") <= k))
