"""Operators 3, 4 and 8 and the pipeline against brute force on small inputs."""

import random
import re

import numpy as np
import pytest
import zstandard

from parkops.llm import blocks, jaccard, suffixdedup, topk

NULL = 2**63 - 1


def test_top_k_equals_brute_force(spark):
    rng = np.random.default_rng(1)
    rows = [(i, (rng.integers(-2, 3, 6) / 64 + 0.001).tolist()) for i in range(300)] + [
        (i, [1., 2., 3., 4., 5., 6.]) for i in range(600, 700)] + [
        (701, None), (720, [1., None, 2., 3., 4., 5.]), (740, [float("nan")] * 6)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    ok = [(i, np.floor(64 * np.array(v)).astype(int)) for i, v in rows[:-3]]
    want = set()
    for i, v in ok:
        if i % 5 == 0:
            best = sorted((-int(w @ v), j) for j, w in ok if j != i)[:7]
            want |= {(i, r, j, -s) for r, (s, j) in enumerate(best, 1)}
    assert {tuple(r) for r in topk.top_k(df, 5, 7, shard=64).collect()} == want
    assert topk.top_k(df.limit(0)).collect() == []


def test_top_k_broadcasts_no_exploded_blocks(spark):
    """Spark sizes a block that meets every shard as one row: small tables passed as broadcasts."""
    rng = np.random.default_rng(2)
    df = spark.createDataFrame([(i, rng.normal(size=4).tolist()) for i in range(200)],
                               "vec_id long, embedding array<double>")
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "10MB")
    try:
        plan = topk.top_k(df, 5, 7, shard=32)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set(key, before)
    assert "Generate" in plan and "Broadcast" not in plan


@pytest.mark.parametrize("scale", [1.0, 2.0**12, 2.0**24, 2.0**31])
def test_search_is_exact_at_every_width(scale):
    """Singles, doubles, longs and whole numbers of any size; ties go to the smaller id."""
    rng = np.random.default_rng(3)
    v = rng.integers(-3, 4, (500, 5)) * np.floor(scale)
    ids = rng.permutation(500)
    at = np.flatnonzero(ids % 5 == 0)
    got = topk.search(ids[at], v[at], ids, v, 6, np.full(len(at), np.iinfo(np.int64).min), block=16)
    want = []
    for row, i in enumerate(at):
        score = [sum(int(x) * int(y) for x, y in zip(v[i], w)) for w in v]
        best = sorted((-min(s, 2**63 - 1), int(j)) for s, j in zip(score, ids) if j != ids[i])[:6]
        want += [(row, j, -s) for s, j in best]
    assert list(zip(*(c.tolist() for c in got))) == want


@pytest.mark.parametrize("sample", [4096, 8])
def test_buckets_are_cut_by_what_is_sent(spark, monkeypatch, sample):
    """Where all suffixes repeat, buckets hold no more than elsewhere; a sample of blocks is
    filtered (sorted whole blocks met in one task)."""
    monkeypatch.setattr(suffixdedup, "BUCKET", 20)
    monkeypatch.setattr(suffixdedup, "SPLITTER_BLOCKS", sample)
    found, whole = [], suffixdedup._splitters

    def noted(table, *args):
        monkeypatch.setattr(type(table), "limit", None)
        found.append(whole(table, *args))
        monkeypatch.undo()
        return found[-1]

    monkeypatch.setattr(suffixdedup, "_splitters", noted)
    rng = np.random.default_rng(6)
    texts = [rng.integers(97, 123, 4000).astype(np.uint8).tobytes() for _ in range(8)]
    df = spark.createDataFrame([(i + n, t.decode()) for n in (0, 100) for i, t in enumerate(texts)],
                               "doc_id long, text string").repartition(16)
    kept = {r.doc_id: bytes(r.kept) for r in suffixdedup.dedup(df).collect()}
    assert kept == {i + n: b"" if n else t for n in (0, 100) for i, t in enumerate(texts)}
    n = 2 * sum(len(suffixdedup.anchors(blocks.Block(np.array([1], "<i8").tobytes(), np.array(
        [len(t)], "<i8").tobytes(), zstandard.compress(t)), 50)) for t in texts)
    assert n / (len(found[0]) + 1) < 2 * 20


def test_anchor_keys_fill_the_ranges_evenly():
    """Anchors have the least hashes of their windows; no range of keys may get more for it."""
    text = np.random.default_rng(4).integers(97, 123, 1 << 20).astype(np.uint8).tobytes()
    block = blocks.Block(np.array([1], "<i8").tobytes(), np.array([len(text)], "<i8").tobytes(),
                         zstandard.compress(text))
    at = suffixdedup.anchors(block, 50)
    keys = suffixdedup._anchor_hashes(block, at, 50)
    assert len(np.unique(keys)) == len(np.unique(suffixdedup.suffixes(block, at, 50)[:, :24], axis=0))
    sizes = np.bincount((keys >> np.uint64(58)).astype(int), minlength=64)
    assert sizes.max() < 1.3 * sizes.mean() and sizes.min() > 0.7 * sizes.mean()


@pytest.mark.parametrize("length,letters", [(8, "ab"), (13, "abé"), (50, "abcd")])
def test_suffix_dedup_equals_brute_force(spark, length, letters):
    rng = random.Random(length)
    pool = ["".join(rng.choices(letters, k=rng.choice([5, length, 90]))) for _ in range(9)]
    rows = [(rng.randrange(30) if rng.random() < .95 else None, "".join(
        rng.choice(pool) if rng.random() < .5 else "".join(rng.choices(letters, k=40))
        for _ in range(rng.randrange(4))), "clash") for _ in range(50)] + [
        (99, None, ""), (98, "", ""), (97, "a" * 500, ""), (96, "a" * 300, "")]
    first = {}
    for i, t, _ in rows:
        b = (t or "").encode()
        for p in range(len(b) - length + 1):
            g = b[p:p + length]
            first[g] = min(first.get(g, NULL), NULL if i is None else i)
    want = []
    for i, t, _ in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if first[b[p:p + length]] < (NULL if i is None else i):
                gone[p:p + length] = b"\1" * length
        runs = [m.span() for m in re.finditer(b"\1+", bytes(gone))]
        want.append((i, bytes(c for c, g in zip(b, gone) if not g), runs))
    df = spark.createDataFrame(rows, "doc_id long, text string, spans string").repartition(4)
    out = suffixdedup.dedup(df, length=length)
    got = [(r.doc_id, bytes(r.kept), [(s.start, s.end) for s in r.spans]) for r in out.collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert suffixdedup.dedup(df.limit(0), length=length).collect() == []


@pytest.mark.parametrize("hot_rows", [2, 5, 40])
def test_hot_keys_give_the_same_result(spark, hot_rows):
    rng = random.Random(hot_rows)
    line = "a line that a third of all documents contain, more or less"
    rows = [(rng.randrange(200) if rng.random() < .95 else None, "".join(
        rng.choices("abc ", k=rng.randrange(60))) + line * rng.randrange(1, 3) + "".join(
        rng.choices("abc ", k=rng.randrange(60)))) for _ in range(120)] + [
        (300 + i, "".join(rng.choices("abcdefgh", k=200))) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    want = sorted((tuple(r) for r in suffixdedup.dedup(df).collect()), key=str)
    got = sorted((tuple(r) for r in suffixdedup.dedup(df, hot_rows=hot_rows).collect()), key=str)
    assert got == want and any(r[2] for r in got)


def test_anchors_of_hot_keys_are_not_sent_to_a_bucket():
    texts = [f"{i:05d} a line that every document contains, and not much else {i:05d}".encode()
             for i in range(40)]
    block = blocks.Block(np.arange(40).astype("<i8").tobytes(),
                         np.array([len(t) for t in texts], "<i8").tobytes(),
                         zstandard.compress(b"".join(texts)))
    at = suffixdedup.anchors(block, 50)
    extra = zstandard.compress(np.diff(at, prepend=0).astype("<u4").tobytes())
    _, n = np.unique(suffixdedup._anchor_hashes(block, at, 50), return_counts=True)
    for hot, cold in ((41, True), (40, False)):
        sent = suffixdedup._Sent(block, extra, n, 50, hot)
        assert (len(sent.rows) >= 40) == cold and (len(sent.hot_at) > 0) == (not cold)


@pytest.mark.parametrize("task_tokens", [2_000_000, 60])
def test_join_equals_brute_force(spark, task_tokens):
    rng = random.Random(5)
    vocab = ["w%d" % i for i in range(400)] + ["Ä"]
    rows = []
    for _ in range(15):
        base = rng.choices(vocab, k=rng.choice([3, 5, 8, 30, 120]))
        for _ in range(rng.choice([1, 2, 5, 20])):
            w = list(base)
            for _ in range(rng.randrange(4)):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            rows.append((len(rows), rng.choice([" ", "\n", "  "]).join(w)))
    rows += [(1000, None), (1001, ""), (1002, " \n"), (1003, "A b C"), (1004, "a B c"),
             (1004, "a B c"), (None, "a b c"), (None, "zzz"), (1005, "x " * 3000)]
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[k:k + 5]) for k in range(len(w) - 4)} if len(w) >= 5
                    else {tuple(w)} if w else set())
    comp = list(range(len(rows)))
    for _ in range(len(rows)):
        before = list(comp)
        for i, a in enumerate(sets):
            for j in range(i):
                n = len(a & sets[j])
                if n and 100 * n >= 80 * len(a | sets[j]):
                    comp[i] = comp[j] = min(comp[i], comp[j])
        if comp == before:
            break
    least = {}
    for (i, _), c in zip(rows, comp):
        least[c] = min(least.get(c, NULL), NULL if i is None else i)
    want = [(i, len(s), None if least[c] == NULL else least[c])
            for (i, _), s, c in zip(rows, sets, comp)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = [tuple(r) for r in jaccard.join(df, task_tokens=task_tokens).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert jaccard.join(df.limit(0)).collect() == []


def test_pipeline_stages_keep_columns_and_decisions(spark):
    import corpus_pipeline as cp
    docs = spark.createDataFrame(
        [(1, "alpha beta gamma delta epsilon zeta eta theta " * 3, "en", "a", 0),
         (2, "alpha beta gamma delta epsilon zeta eta theta " * 3, "en", "a", 0),
         (3, "password: hunter2hunter2 is here", "en", "b", 0), (4, None, None, None, None)],
        "doc_id long, text string, lang string, source string, n_chars long")
    sf = "/root/testdata/sf0.001"
    for name, stage in cp.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
    rows = {r.doc_id: r for r in docs.collect()}
    assert sorted(rows) == [1, 3, 4]
    assert rows[3].text == "[SECRET] is here" and rows[3].n_chars == len(rows[3].text)
    assert cp.STAGES[-1][1](spark, docs, sf).count() == 3


def test_passes_join_blocks_without_shuffling_them_again(spark):
    from parkops.llm.blocks import in_blocks
    docs = spark.range(300).selectExpr("id as doc_id", "repeat(cast(id as string), 40) as text")
    table = in_blocks(docs, [], lambda block: (b"x", 1), block_bytes=500)
    n = table.count()
    sent = table.select("block").groupBy("block").count()
    both = table.select("block", "data").join(sent, "block")
    p = both._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in p and "Exchange" not in p, p
    other = spark.range(10).selectExpr("id as block").groupBy("block").count()
    p = table.select("block", "data").join(other, "block")._jdf.queryExecution().executedPlan().toString()
    assert p.count("Exchange hashpartitioning") == 1, p
    assert both.count() == n > 4 and not [t for t in spark.catalog.listTables() if "parkops" in t.name]
