"""Deletions that follow references, planned lazily.

A plan starts from the keys to delete in one table and a policy: which references take their
rows along and which become NULL. ``keys`` walks ``schema.FOREIGN_KEYS`` from a table towards
the start and builds only the key sets on the way, each at most once; ``table`` is a table
after the deletion. Building either starts no job. With ``keep`` the key sets are materialised
when first used, for callers that write several tables of one plan.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parkops.operators.skew import hot_map, spread_join
from parkops.session import cut_lineage
from parkops.sources import schema as S

Reference = tuple[str, str]  # child table, column


@dataclass
class Deletion:
    start: str                       # the table whose keys are given
    start_keys: DataFrame            # one column, its primary key
    tables: dict[str, DataFrame]     # tables on the way
    deletes: frozenset[Reference]    # references that take their row along
    nullifies: frozenset[Reference] = frozenset()
    keep: bool = False
    _keys: dict[str, DataFrame] = field(default_factory=dict)

    def _parents(self, table: str, of: frozenset[Reference]) -> list[tuple[str, str]]:
        """(column, parent) of the table's references among ``of`` that lead to the start."""
        return [(col, parent) for child, col, parent, _ in S.FOREIGN_KEYS
                if child == table and (child, col) in of and self._reached(parent)]

    def _reached(self, table: str) -> bool:
        return table == self.start or bool(self._parents(table, self.deletes))

    def keys(self, table: str) -> DataFrame:
        """The primary keys that the deletion takes from the table."""
        if table not in self._keys:
            pk = S.PRIMARY_KEYS[table][0]
            if table == self.start:
                found = self.start_keys.select(pk)
            else:
                rows = self.tables[table]
                found = reduce(DataFrame.unionByName, [
                    rows.select(pk, F.col(col).alias("_ref")).join(
                        self.keys(parent).toDF("_ref"), "_ref", "left_semi").select(pk)
                    for col, parent in self._parents(table, self.deletes)])
            found = found.distinct()
            self._keys[table] = cut_lineage(found) if self.keep else found
        return self._keys[table]

    def table(self, name: str, rows: DataFrame | None = None) -> DataFrame:
        """The table after the deletion."""
        df = self.tables[name] if rows is None else rows
        refs = self._parents(name, self.deletes)
        if name == self.start:
            refs.insert(0, (S.PRIMARY_KEYS[name][0], name))
        if len(refs) == 1:
            (col, parent), = refs
            df = df.join(self.keys(parent).toDF(col), col, "left_anti")
        elif refs:
            df = self._without(df, name, refs)
        for col, parent in self._parents(name, self.nullifies):
            df = self._cleared(df, col, self.keys(parent))
        return df

    def _without(self, df: DataFrame, name: str, refs: list[tuple[str, str]]) -> DataFrame:
        """``df`` without the rows that any of the references takes along: the references are
        looked up as (place, key) pairs in one set, and whole rows are shuffled once."""
        pk = list(S.PRIMARY_KEYS[name])
        wanted = reduce(DataFrame.unionByName, [
            self.keys(parent).toDF("_ref").withColumn("_at", F.lit(i)) for i, (_, parent) in enumerate(refs)])
        pairs = F.array(*[F.struct(F.lit(i).alias("_at"), F.col(col).alias("_ref"))
                          for i, (col, _) in enumerate(refs)])
        gone = (df.select(*pk, F.inline(F.filter(pairs, lambda p: p["_ref"].isNotNull())))
                .join(wanted, ["_at", "_ref"], "left_semi").select(*pk).distinct())
        return df.join(gone, pk, "left_anti")

    def _cleared(self, df: DataFrame, col: str, keys: DataFrame) -> DataFrame:
        """NULL in place of references to deleted keys."""
        hit = keys.toDF(col).withColumn("_hit", F.lit(True))
        j = spread_join(df, hit, col, "left", hot_map(df, col), [c for c in df.columns if c != col])
        return j.select(*[F.when(F.col("_hit"), F.lit(None)).otherwise(F.col(c)).alias(c)
                          if c == col else F.col(c) for c in df.columns])
