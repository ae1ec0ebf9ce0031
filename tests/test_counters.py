"""Maintained counters equal counting anew, after each of several batches, and read only the
rows that a batch touches."""

import random

from pyspark.sql import functions as F

from parkops.operators.counters import BY_STATUS, BY_USER


def test_equal_to_counting_anew_after_each_batch(spark):
    rng = random.Random(4)
    state = {i: (i % 7 if i % 3 else 1, rng.choice(["Pending", "Approved", None])) for i in range(200)}

    def frame():
        return spark.createDataFrame([(i, u, s) for i, (u, s) in state.items()],
                                     "request_id long, user_id long, status string")

    stored = [BY_STATUS.of(frame()), BY_USER.of(frame())]
    for _ in range(3):
        rows = frame()
        batch = {i: rng.choice(["Approved", "Rejected", "Pending"]) for i in rng.sample(range(250), 60)}
        gone = {i for i in batch if i % 10 == 0}
        change = spark.createDataFrame([(i, s) for i, s in batch.items()], "request_id long, new string")

        def apply(before):
            after = before.join(change, "request_id").withColumn("status", F.col("new"))
            return after.filter(F.col("request_id") % 10 != 0).select(*before.columns)

        stored = [c.after_batch(old, rows, "request_id", change, apply)
                  for c, old in zip((BY_STATUS, BY_USER), stored)]
        for i, s in batch.items():
            if i in state:
                state[i] = (state[i][0], s)
                if i in gone:
                    del state[i]
        for c, now in zip((BY_STATUS, BY_USER), stored):
            assert sorted(map(tuple, now.collect()), key=str) == \
                sorted(map(tuple, c.of(frame()).collect()), key=str)


def test_a_batch_that_changes_nothing_has_no_deltas(spark):
    rows = spark.createDataFrame([(1, 1, "Pending"), (2, 1, None)],
                                 "request_id long, user_id long, status string")
    assert BY_STATUS.deltas(rows, rows).collect() == []
