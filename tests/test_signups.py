"""Sign-ups: settled like row at a time on random batches, and a long chain in few rounds."""

import random

import pytest

from parkops.operators import signups as SU


def greedy(rows):
    ids, phones, ok = set(), set(), []
    for pos, lid, phone in sorted(rows):
        if lid in ids or (phone is not None and phone in phones):
            continue
        ok.append(pos)
        ids.add(lid)
        if phone is not None:
            phones.add(phone)
    return ok


def settled(spark, rows):
    df = spark.createDataFrame(rows, "pos long, lid string, phone string").repartition(3)
    return sorted(r.pos for r in SU.settle(df).collect())


@pytest.mark.parametrize("seed,many", [(1, 4), (2, 12), (3, 40)])
def test_equals_row_at_a_time(spark, seed, many):
    rng = random.Random(seed)
    rows = [(i, f"i{rng.randrange(many)}", None if rng.random() < .15 else f"p{rng.randrange(many)}")
            for i in range(60)]
    assert settled(spark, rows) == greedy(rows)


def test_one_id_on_a_third_of_the_rows(spark):
    rows = [(i, "hot" if i % 3 == 0 else f"i{i}", f"p{i % 50}") for i in range(300)]
    assert settled(spark, rows) == greedy(rows)


def test_a_long_chain_takes_logarithmic_rounds(spark, monkeypatch):
    # each row shares its id with the one before or its phone with the one after
    n = 100_000
    cuts = []
    plain = SU.cut_lineage
    monkeypatch.setattr(SU, "cut_lineage", lambda df: cuts.append(1) or plain(df))
    df = spark.range(n).selectExpr("id as pos", "concat('i', (id + 1) div 2) as lid",
                                   "concat('p', id div 2) as phone")
    got = SU.settle(df)
    assert got.count() == n // 2 and got.filter("pos % 2 = 1").isEmpty()
    assert len(cuts) < 30


def test_null_id_is_an_id(spark):
    assert settled(spark, [(1, "", "a"), (2, "", "b"), (3, "x", None), (4, "y", None)]) == [1, 3, 4]
