"""Joins on a column whose values are unevenly spread.

``hot_map`` is a frequent-items sketch of the column: its values with more rows than an
average shuffle partition, and over how many partitions each is to be spread. It is one row,
a subquery of the plan that uses it. ``spread_join`` adds a salt to the join key: rows of a
hot value are dealt by a hash of their own key over that many partitions, and the value's rows
on the other side are repeated for each; NULLs, which meet nothing, are dealt over all
partitions; every other value keeps salt 0. One pass over each side, one shuffle, no branch
per kind of value, and results don't depend on what the sketch finds.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Frequent values looked for, and counters of the sketch.
TOP, TRACKED = 1000, 100_000
_SALT = "_salt"


def _partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def hot_map(df: DataFrame, col: str) -> Column:
    """Map (a scalar subquery) of the column's frequent values to their number of salts.
    All values together get at most two salts per shuffle partition."""
    parts = _partitions(df)
    sketch = df.agg(F.expr(f"approx_top_k({col}, {TOP}, {TRACKED})").alias("top"),
                    F.count(F.lit(1)).alias("n"))
    often = F.filter("top", lambda t: t["item"].isNotNull() & (t["count"] * parts > F.col("n")))
    return sketch.select(F.map_from_entries(F.transform(often, lambda t: F.struct(
        t["item"], F.ceil(t["count"] * parts / F.col("n")).cast("int")))).alias("hot")).scalar()


def spread_join(left: DataFrame, right: DataFrame, key: str, how: str, hot: Column,
                by: Sequence[str]) -> DataFrame:
    """``left`` joined to ``right`` on ``key`` (inner, left, left_semi or left_anti). ``by``:
    columns of ``left`` that tell rows of one key value apart."""
    deal = F.pmod(F.xxhash64(*by), F.lit(_partitions(left)))
    salts = F.try_element_at(hot, F.col(key))
    own = F.when(F.col(key).isNull(), deal).otherwise(
        F.coalesce(F.pmod(F.xxhash64(*by), salts), F.lit(0))).cast("int")
    salted = left.withColumn(_SALT, own)
    copies = right.withColumn(_SALT, F.explode(F.sequence(F.lit(0), F.coalesce(salts, F.lit(1)) - 1)))
    return salted.join(copies, [key, _SALT], how).drop(_SALT)
