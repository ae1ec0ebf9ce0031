"""Operator 10 against a brute-force I-Match on a small table with null, repeated and equal
ids, equal texts and empty texts."""

import hashlib
import random
import re
import struct

import xxhash

from parkops.llm import imatch as I

LO, HI = 0.05, 0.6


def hash_text(t):
    return signed(xxhash.xxh64_intdigest(t.encode(), seed=42))


def signed(h):
    return h - (1 << 64) if h >> 63 else h


def hash_longs(values, kinds="q"):
    seed = 42
    for v, kind in values:
        seed = xxhash.xxh64_intdigest(struct.pack("<" + kind, v), seed=seed)
    return signed(seed)


def runs(text):
    return {t for t in re.split(I._BREAKS, text.lower()) if 2 <= len(t) <= 40}


def brute(rows):
    texts = [t or "" for _, t in rows]
    df = {}
    for t in texts:
        for w in runs(t):
            df[w] = df.get(w, 0) + 1
    n = len(texts)
    band = {w for w, c in df.items() if max(2, LO * n) <= c <= HI * n}

    def prints(text):
        every = runs(text)
        used = every & band if len(every & band) >= I.FEW else every
        if not used:
            return ["=" + hashlib.md5(text.encode()).hexdigest()]
        out = []
        for family in range(I.FAMILIES):
            for rate in I.RATES:
                own = sorted(h for h in map(hash_text, used) if all(
                    hash_longs([(h, "q"), (family, "i")]) & ((1 << r) - 1) == 0
                    for r in I.RATES if r <= rate))
                out.append("-" if not own else
                           f"{hash_longs([(h, 'q') for h in own]) & (1 << 64) - 1:X}"[:8].lower())
        return out

    def near(a, b):
        if a == b:
            return 1.0
        pairs = [(x, y) for x, y in zip(a + ["-"] * 200, b + ["-"] * 200)]
        some = sum(x != "-" or y != "-" for x, y in pairs)
        return sum(x == y != "-" for x, y in pairs) / some if some else 0.0

    order = sorted(range(n), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, hash_text(texts[i])))
    got = []
    for at, i in enumerate(order):
        t, nxt = texts[i], texts[order[(at + 1) % n]]
        half = len(t) // 2
        edited = t[:len(t) - half] + nxt[:half]
        a, b, c = prints(t), prints(edited), prints(nxt)
        got.append((rows[i][0], len(t), hashlib.sha256(edited.encode()).hexdigest(), ".".join(a),
                    ".".join(b), round(near(a, b), 9), round(near(a, c), 9)))
    return got


def table():
    rng = random.Random(5)
    words = [f"wörd{i}x" for i in range(60)] + ["the", "of", "a"]
    text = lambda: " ".join(rng.choice(words) + rng.choice(["", ".", ","])
                            for _ in range(rng.randrange(1, 60)))
    rows = [(i, text()) for i in range(60)]
    rows += [(None, text()) for _ in range(15)] + [(None, rows[3][1])] + [(7, text()) for _ in range(12)]
    rows += [rows[5]] * 4 + [(200, rows[5][1]), (-3, None), (201, ""), (202, "?! "), (2**63 - 1, text())]
    return rows


def test_equals_brute_force(spark):
    rows = table()
    df = spark.createDataFrame([(i, t, "clash") for i, t in rows],
                               "doc_id long, text string, _h string").repartition(5)
    for range_docs in (8, 4096):
        got = [(r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint,
                round(r.near_edited, 9), round(r.near_next, 9))
               for r in I.fingerprints(df, LO, HI, range_docs).collect()]
        assert sorted(got, key=str) == sorted(brute(rows), key=str)


def test_a_large_lexicon_is_whole(spark, monkeypatch):
    """A lexicon of more terms than a row holds keeps all of them (before: a random share)."""
    monkeypatch.setattr(I, "MAX_LEXICON", 20)
    rows = table()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = [(r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint,
            round(r.near_edited, 9), round(r.near_next, 9))
           for r in I.fingerprints(df, LO, HI, 8).collect()]
    assert sorted(got, key=str) == sorted(brute(rows), key=str)


def test_few_rows(spark):
    df = spark.createDataFrame([(1, "only one text")], "doc_id long, text string")
    (r,) = I.fingerprints(df).collect()
    assert (r.n_chars, r.near_next) == (13, 1.0)
    assert I.fingerprints(df.limit(0)).collect() == []


def test_no_python_in_the_plan(spark):
    df = spark.createDataFrame(table(), "doc_id long, text string")
    plan = I.fingerprints(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
