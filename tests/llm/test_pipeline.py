"""The pipeline against a brute-force version of its stages, on documents with null, repeated
and clashing ids, exact and near copies, shared passages and secrets."""

import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline as P
from parkops.llm import common, toxicity

NULL = 2**63 - 1


def shingles(text):
    out, word = [], []
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    for c in low + " ":
        if c == " " or "\t" <= c <= "\r":
            if word:
                out.append("".join(word))
            word = []
        else:
            word.append(c)
    if not out:
        return frozenset()
    return frozenset(tuple(out[i:i + 5]) for i in range(max(1, len(out) - 4)))


def near_duplicates(rows):
    """The rows that stay: of each component the least by (id null, id)."""
    sets = [shingles(r[1] or "") for r in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    best = {}
    for i, r in enumerate(rows):
        key = find(i) if sets[i] else ("empty", i)
        order = (r[0] is None, r[0] or 0)
        if key not in best or order < best[key][0]:
            best[key] = (order, i)
    return [rows[i] for _, i in best.values()]


def without_repeats(rows):
    first = {}
    for i, t, *_ in rows:
        b = (t or "").encode()
        for p in range(len(b) - 49):
            first[b[p:p + 50]] = min(first.get(b[p:p + 50], NULL), NULL if i is None else i)
    out = []
    for i, t, *rest in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - 49):
            if first[b[p:p + 50]] < (NULL if i is None else i):
                gone[p:p + 50] = b"\1" * 50
        out.append((i, bytes(c for c, g in zip(b, gone) if not g).decode("utf-8", "ignore"), *rest))
    return out


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(11)
    words = ["".join(rng.choices("abcdeghilmnoprstu", k=rng.randrange(3, 9))) for _ in range(400)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    shared = text(30)
    rows = [(i, text(rng.randrange(20, 90))) for i in range(40)]
    rows += [(100, rows[3][1]), (101, rows[4][1] + " tail"), (2, rows[1][1]), (None, rows[5][1]),
             (None, text(40)), (9, rows[9][1]), (9, rows[9][1]), (6, text(50)), (6, text(50))]
    rows += [(50, text(9) + " " + shared + " " + text(12)), (51, text(15) + " " + shared),
             (52, "password = Zk3mWq9tLx82 " + text(25)), (53, ""), (54, ""), (None, None), (53, "")]
    rows += [(200 + i, "vile scumbag filth " * 2 + text(20)) for i in range(12)]
    path = tmp_path_factory.mktemp("docs")
    docs = [(i, t, None if t is None else len(t), "kept", 7) for i, t in rows]
    spark.createDataFrame(docs, "doc_id long, text string, n_chars int, _score string, _key int") \
        .repartition(3).write.parquet(f"{path}/documents.parquet")
    labels = [(i, int(i >= 200)) for i, _ in rows if i is not None]
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path), docs


def test_run_equals_brute_force(spark, folder, monkeypatch):
    path, _ = folder
    docs = common.read(spark, path, "documents")
    types = dict(docs.dtypes)
    kept = P.STAGES[0][1](spark, docs, path)
    assert dict(kept.dtypes) == types
    rows = [tuple(r) for r in kept.collect()]
    model = toxicity.fit(docs, common.read(spark, path, "labels"))
    scorer = model.scorer()
    every = [tuple(r) for r in docs.collect()]
    ok = [r for r in every if model.score(scorer.features(r[1] or "")) < 0.5]
    assert sorted(rows, key=str) == sorted(ok, key=str)
    assert {r[3:] for r in rows} == {("kept", 7)}

    kept = common.written(kept, "test")
    out = common.written(P.STAGES[1][1](spark, kept, path), "test")
    assert dict(out.dtypes) == types
    rows = near_duplicates(rows)
    # rows alike in all columns are interchangeable
    assert sorted(map(tuple, out.collect()), key=str) == sorted(rows, key=str)

    out = common.written(P.STAGES[2][1](spark, out, path), "test")
    assert dict(out.dtypes) == types
    rows = without_repeats(rows)
    got = sorted((r.doc_id, r.text) for r in out.filter("doc_id is not null").collect())
    assert got == sorted((r[0], r[1]) for r in rows if r[0] is not None)
    assert [len(r.text) for r in out.collect()] == [r.n_chars for r in out.collect()]

    out = common.written(P.STAGES[3][1](spark, out, path), "test")
    assert dict(out.dtypes) == types
    masked = [r.text for r in out.filter("doc_id = 52").collect()]
    assert len(masked) == 1 and "[SECRET]" in masked[0] and "Zk3mWq9tLx82" not in masked[0]

    texts = sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in out.collect())
    packed = P.run(spark, path).collect()
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = sorted((none, i, tuple(tok.encode(t, add_special_tokens=False).ids) + (2,))
                  for none, i, t in texts)
    pieces = {}
    for r in packed:
        ids = tuple(int.from_bytes(r.ids[a:a + 4], "little") for a in range(0, len(r.ids), 4))
        assert len(ids) == r.length <= 1024
        pieces.setdefault((r.doc_id is None, r.doc_id or 0), []).append(ids)
    assert sorted((*k, ids) for k, v in pieces.items() for ids in v) == want


def test_tables_of_earlier_stages_are_deleted(spark, folder):
    path, _ = folder
    before = set(tables(spark))
    P.run(spark, path)
    left = set(tables(spark)) - before
    assert len(left) == 1 and "stage-packing" in left.pop()


def tables(spark):
    import os
    root = common.shared_dir(spark).removeprefix("file:")
    return [n for n in os.listdir(root) if n.startswith("parkops-")]


def test_top_k_of_huge_components(spark):
    from parkops.llm import topk
    big = 1e17
    rows = [(20, [big, 1.0]), (1, [big, 0.0]), (2, [-big, 0.0]), (3, [0.5, 2.0]), (4, [0.5, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [tuple(r) for r in topk.top_k(df, 20, 4).orderBy("rank").collect()]
    top = 2**63 - 1
    exact = int(64 * big) * 32 + 64 * 128
    assert got == [(20, 1, 1, top), (20, 2, 3, min(exact, top)), (20, 3, 4, min(exact, top)),
                   (20, 4, 2, 1 - 2**63)]
