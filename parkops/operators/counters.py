"""Counters kept up to date by batches.

A counter table is an aggregate stored once. A batch changes few rows; their state before it
counts -1 and their state after it +1, and the sums of these signed rows are added to the
stored counters. Neither the whole table nor untouched counters are read again, and sums are
combined map-side, so a counter that a third of the batch belongs to is one row per map task.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Counters:
    """group: columns that name a counter row; measures: the condition (SQL) of the rows that
    each measure counts."""

    group: tuple[str, ...]
    measures: dict[str, str]

    def _signed(self, rows: DataFrame, sign: int) -> DataFrame:
        return rows.select(*self.group, *[F.when(F.expr(c), F.lit(sign)).otherwise(0).cast("long").alias(m)
                                          for m, c in self.measures.items()])

    def _sum(self, parts: list[DataFrame]) -> DataFrame:
        every = reduce(DataFrame.unionByName, parts)
        return every.groupBy(*self.group).agg(*[F.sum(m).cast("long").alias(m) for m in self.measures])

    def of(self, rows: DataFrame) -> DataFrame:
        """The counters of a table, from scratch."""
        return self._sum([self._signed(rows, 1)])

    def deltas(self, before: DataFrame, after: DataFrame) -> DataFrame:
        """What a batch adds to the counters, from the rows it touches before and after it."""
        found = self._sum([self._signed(before, -1), self._signed(after, 1)])
        return found.filter(reduce(lambda a, b: a | b, [F.col(m) != 0 for m in self.measures]))

    def updated(self, stored: DataFrame, deltas: DataFrame) -> DataFrame:
        """The stored counters after the batch; rows that count nothing any more are left out."""
        found = self._sum([stored.select(*self.group, *self.measures), deltas])
        return found.filter(reduce(lambda a, b: a | b, [F.col(m) != 0 for m in self.measures]))

    def after_batch(self, stored: DataFrame, rows: DataFrame, key: str, batch_keys: DataFrame,
                    change: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """The stored counters of ``rows`` after ``change`` of the rows whose key is in the batch."""
        before = rows.join(batch_keys.select(key).distinct(), key, "left_semi")
        return self.updated(stored, self.deltas(before, change(before)))


BY_STATUS = Counters(("status",), {"n": "true"})
BY_USER = Counters(("user_id",), {
    "request_count": "true", "pending_count": "status <=> 'Pending'",
    "approved_count": "status <=> 'Approved'", "rejected_count": "status <=> 'Rejected'"})
