"""Operators 11 to 13 against brute force: nulls in any column, empty and long texts, ties,
repeated rows, empty tables, clashing columns, and their ways beyond the usual sizes."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from parkops.llm import lexical, mixing, spelling

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


# --- op11 ---

def ranked(items, docs, k):
    bags = [(i, Counter(TERM.findall(low(t)))) for i, t in docs]
    bags = [(i, b, sum(b.values())) for i, b in bags if b]
    n_docs, n_terms = len(bags), sum(n for _, _, n in bags)
    df = Counter(t for _, b, _ in bags for t in b)
    out = []
    for item, text in items:
        scores = []
        for i, b, n in bags:
            m = 75 + 25 * n * n_docs // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    * (1_000_000_000 * b[t] // (1000 * b[t] + 12 * m))
                    for t in TERM.findall(low(text)) if b[t])
            if s > 0:
                scores.append((-s, i is None, i or 0, i))
        out += [(item, r, x[3], -x[0]) for r, x in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


def corpus(seed=3):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(40)] + ["Ünï", "ABC", "abc", "Abc9", "x"]
    text = lambda n: rng.choice([" ", "-", "\n", "."]).join(rng.choice(words) for _ in range(n))
    docs = [(i, text(rng.randrange(0, 60))) for i in range(80)]
    docs += [(5, docs[5][1]), (None, docs[7][1]), (None, None), (90, ""), (91, " .. "), (92, docs[9][1]),
             (93, docs[9][1]), (94, text(9000))]
    items = [(i, text(rng.randrange(1, 14))) for i in range(25)]
    items += [(3, items[3][1]), (None, text(5)), (30, None), (31, "?!"), (32, "nowhere"),
              (33, "w1 w1 w1 w2"), (34, "w1 w2 w3"), (35, "w1 w2 w3 w4")]
    return items, docs


@pytest.mark.parametrize("block_bytes,slice_,k", [(1 << 20, 1 << 20, 6), (150, 64, 20)])
def test_search_equals_brute_force(spark, monkeypatch, block_bytes, slice_, k):
    monkeypatch.setattr(lexical, "SLICE", slice_)
    items, docs = corpus()
    a = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, score long")
    b = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, terms string")
    got = [tuple(r) for r in lexical.search(a, b.repartition(3), k, block_bytes).collect()]
    assert sorted(got, key=str) == ranked(items, docs, k)


def test_search_of_empty_tables(spark):
    items, docs = corpus()
    a = spark.createDataFrame(items, "item_id long, text string")
    b = spark.createDataFrame(docs, "doc_id long, text string")
    assert lexical.search(a.limit(0), b).collect() == []
    assert lexical.search(a, b.limit(0)).collect() == []


def test_shared_sets_are_evaluated_once():
    items = [{b"a": 1, b"b": 1, b"c": 1, b"d": 2}, {b"a": 1, b"b": 1, b"c": 1}, {b"a": 1, b"b": 1},
             {b"e": 1}]
    plan = lexical.with_levels(lexical.mine(items))
    rng = np.random.default_rng(1)
    weight = rng.integers(1, 9, len(plan["terms"]))
    doc, term = (x.ravel() for x in np.meshgrid(np.arange(3), np.arange(len(plan["terms"])), indexing="ij"))
    part = rng.integers(0, 99, len(doc))
    item, d, score = lexical.evaluate(plan, weight, doc, term, part, 3)
    got = defaultdict(int, {(int(i), int(x)): int(s) for i, x, s in zip(item, d, score)})
    for i, terms in enumerate(items):
        for x in range(3):
            assert got[i, x] == sum(times * int(weight[t]) * int(part[x * len(plan["terms"]) + t])
                                    for t, w in enumerate(plan["terms"]) for times in [terms.get(w, 0)])
    # a, b share a class; the class and c make a node: fewer additions than term by term
    assert sum(len(e[0]) for e in plan["edges"]) < sum(map(len, items))


# --- op12 ---

def shares(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: 1 + i % 3 for i, s in enumerate(order)}
    target = {s: 0.0 for s in order}
    full, total = set(), sum(sizes.values())
    while True:
        rest = total - sum(3 * sizes[s] for s in full)
        w = sum(weight[s] for s in order if s not in full)
        target = {s: 3.0 * sizes[s] if s in full else rest * weight[s] / w for s in order}
        over = {s for s in order if s not in full and target[s] > 3 * sizes[s]}
        if not over:
            return target
        full |= over


def mixture(spark, rows, **how):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows],
                               "doc_id long, text string, source string, size int, s string")
    return mixing.mix(df.repartition(4), **how)


def documents():
    rng = random.Random(9)
    words = lambda n: "\t ".join(["wörd"] * n)
    rows = [(i, words(rng.randrange(0, 40)), rng.choice(["a", "B", "", None, "é", "z"])) for i in range(120)]
    rows += [(None, words(n), "a") for n in (3, 3, 0, 9)] + [(7, words(5), "B")] * 6 + [
        (8, None, "a"), (9, "", "none"), (10, words(900), "big"), (11, words(2), "tiny"), (12, "x", "one")]
    return rows


@pytest.mark.parametrize("block,shard,bucket,limit", [(16, 8, 10, 20_000), (7, 1000, 1000, 2), (128, 4, 3, 20_000)])
def test_mix_reaches_targets_and_repeats(spark, monkeypatch, block, shard, bucket, limit):
    monkeypatch.setattr(mixing, "MAX_BROADCAST", limit)
    monkeypatch.setattr(mixing, "COPIES", 4)
    rows = documents()
    m = mixture(spark, rows, block=block, shard=shard, bucket=bucket)
    got = m.slots.collect()
    taken = mixing.taken(m).collect()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert sorted((r.doc_id, r.size) for r in taken if r.doc_id is not None) == \
        sorted((i, size(t)) for i, t, _ in rows if i is not None)
    assert all(0 <= r.taken <= 3 * r.size for r in taken) and len(taken) == len(rows)
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += size(t)
    target = shares(sizes)
    by_source = {r.source: r for r in m.sources.collect()}
    for s, want in target.items():
        assert by_source[s].source_size == sizes[s] and by_source[s].target == pytest.approx(want)
    total = Counter()
    for r in taken:
        total[r.source_size, round(r.target, 6)] += r.taken
    for s, want in target.items():
        same = [x for x in target if (sizes[x], round(target[x], 6)) == (sizes[s], round(want, 6))]
        assert total[sizes[s], round(want, 6)] == sum(round(target[x]) for x in same)
    # every slot once, every place of a shard once, no block more than once in a pass
    assert len({(r.s, r.k) for r in got}) == len({(r.shard, r.place) for r in got}) == len(got)
    assert len({(r.s, r.epoch, r.block) for r in got}) == len(got)
    # the mix itself holds the words that are counted
    words = mixing.stream(m).groupBy().agg(F.sum("words")).first()[0]
    assert words == sum(r.taken for r in taken)
    again = mixing.taken(mixture(spark, random.Random(1).sample(rows, len(rows)), block=block, shard=shard,
                                 bucket=bucket)).collect()
    assert sorted(map(tuple, taken), key=str) == sorted(map(tuple, again), key=str)


def test_mix_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.taken(mixing.mix(empty)).collect() == []
    silent = mixing.taken(mixture(spark, [(1, None, "a"), (2, "", None)])).collect()
    assert sorted((r.doc_id, r.size, r.source_size, r.target, r.taken) for r in silent) == [
        (1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)]


def test_mix_has_no_python_in_its_plan(spark):
    plan = mixing.taken(mixture(spark, documents()))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


# --- op13 ---

def variants(docs):
    count = Counter()
    for i, t in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = low(run)
            h = zlib.crc32(f"{'null' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            count[run] += 1
    words = {w: n for w, n in count.items() if len(w) >= 6 and n >= 5}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))

    out, form = [], {}
    for w, n in words.items():
        close = [x for x in words if near(w, x)]
        best = min(close, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best and words[best] >= 5 * n else None
        out.append([w, form[w], n, len(close), words[best] if form[w] else None])
    for row in out:
        root = row[0]
        while form[root]:
            root = form[root]
        row.insert(2, root)
    return sorted(map(tuple, out), key=str)


def spelled():
    rng = random.Random(2)
    stems = ["garage", "vehicle", "parking", "référence", "aaaaaab", "ticketing", "ÀÁÂÃÄÅ"]
    texts = []
    for _ in range(60):
        text = []
        for _ in range(rng.randrange(5, 60)):
            w = rng.choice(stems)
            if rng.random() < .25:
                at = rng.randrange(len(w))
                w = rng.choice([w[:at] + w[at + 1:], w[:at] + rng.choice("aéxz") + w[at:],
                                w[:at] + rng.choice("aéxz") + w[at + 1:]])
            text.append(w.upper() if rng.random() < .1 else w)
        texts.append(rng.choice([" ", "-", "1", "œ", "\U0001F600"]).join(text))
    return [(i, t) for i, t in enumerate(texts)] + [(None, texts[0]), (3, texts[3]), (3, texts[3]),
                                                    (99, None), (98, ""), (97, "1 2 3"), (96, "Ab" * 4000)]


@pytest.mark.parametrize("parts,held,slice_", [(8, 200_000, 1 << 20), (3, 5, 16)])
def test_variants_equal_brute_force(spark, monkeypatch, parts, held, slice_):
    monkeypatch.setattr(spelling, "HELD", held)
    monkeypatch.setattr(spelling, "SLICE", slice_)
    docs = spelled()
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id long, text string, n int, word string")
    got = [tuple(r) for r in spelling.variants(df.repartition(3), parts=parts).collect()]
    assert sorted(got, key=str) == variants(docs)
    assert spelling.variants(df.limit(0)).collect() == []


def test_variants_broadcast_nothing(spark):
    """Spark sizes a word's exploded signatures as one row: small files passed as broadcasts."""
    df = spark.createDataFrame(spelled(), "doc_id long, text string")
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "10MB")
    try:
        counted = spelling.written(spelling.words(df, 1), "spelling-words")
        plans = [d._jdf.queryExecution().executedPlan().toString()
                 for d in (spelling.near_pairs(counted), spelling.variants(df))]
    finally:
        spark.conf.set(key, before)
    assert "Generate" in plans[0] and not any("Broadcast" in p for p in plans)


def test_forms_are_followed_to_the_last(spark):
    chain = ["abcdefgh"[:6] + "a" * i for i in range(6)]  # each is near the next
    docs = [(i, (w + " ") * 5 ** (i + 1)) for i, w in enumerate(chain)]
    got = {r.word: (r.form, r.root, r.n) for r in spelling.variants(
        spark.createDataFrame(docs, "doc_id long, text string"), min_count=5).collect()}
    want = variants(docs)
    assert {w: (f, r, n) for w, f, r, n, _, _ in want} == got
