"""Positions in a sort order without a single-partition window and without a copy.

``row_number()`` over an unpartitioned window moves every row into one task. Here the
order is cut at quantiles of its keys: about ``PER_BUCKET`` keys per bucket, chosen by
their hash from all rows, are sorted, and every n-th is a bound. A row's bucket is the
number of bounds before it (a binary search in the row); its position is its number in its
bucket plus the rows of all earlier buckets. Bounds and counts read the order's keys only
and are subqueries of one lazy plan: building it starts no job, nothing is materialised,
and rows are shuffled once, by bucket. Equal leading keys don't matter, since bounds are
whole keys: a hot value is cut like any other range.

The order must be total (add unique tie-breakers) so that positions are reproducible.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Buckets at most, and keys sampled per bucket: at 100 TB a bucket is about 1.5 GB, and
#: the sample some MB.
MAX_BUCKETS, PER_BUCKET = 65_536, 4


class Key(NamedTuple):
    """One key of an order. Ascending puts NULL first, descending last (Spark's default)."""

    expr: Column
    descending: bool = False

    def sort(self) -> Column:
        return self.expr.desc_nulls_last() if self.descending else self.expr.asc_nulls_first()


def asc(c: Column | str) -> Key:
    return Key(F.col(c) if isinstance(c, str) else c)


def desc(c: Column | str) -> Key:
    return Key(F.col(c) if isinstance(c, str) else c, True)


def _not_after(order: Sequence[Key], a: Sequence[Column], b: Sequence[Column]) -> Column:
    """``a`` comes before ``b`` in the order or equals it."""
    out = F.lit(True)
    for key, x, y in reversed(list(zip(order, a, b))):
        first, second = (y, x) if key.descending else (x, y)
        before = F.coalesce(first < second, first.isNull() & second.isNotNull())
        out = F.when(before, True).when(x.eqNullSafe(y), out).otherwise(False)
    return out


def _names(order: Sequence[Key]) -> list[str]:
    return [f"k{i}" for i in range(len(order))]


def _key(order: Sequence[Key]) -> Column:
    """The keys of a row as one struct, which Spark's optimizer looks through."""
    return F.struct(*[k.expr.alias(n) for k, n in zip(order, _names(order))]).alias("_k")


def _own(order: Sequence[Key]) -> list[Column]:
    return [F.col("_k")[n] for n in _names(order)]


def _of_key(order: Sequence[Key]) -> list[Key]:
    """The order, of rows that have ``_k`` already."""
    return [Key(c, k.descending) for c, k in zip(_own(order), order)]


def _keys(df: DataFrame, order: Sequence[Key]) -> DataFrame:
    return df.select(_key(order))


def bucket_count(df: DataFrame) -> int:
    """Buckets for a session's shuffles: two per partition, within ``MAX_BUCKETS``."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(2, min(MAX_BUCKETS, 2 * parts))


def order_bounds(keys: DataFrame, order: Sequence[Key], buckets: int) -> DataFrame:
    """One row, one array: at most about ``buckets`` bounds in order. ``keys`` has the column
    ``_k`` of the order's keys. The sample is a share of the keys' hashes, so it is the same
    however the rows are read."""
    want = buckets * PER_BUCKET
    rows = keys.select(F.count(F.lit(1))).scalar()
    below = F.pmod(F.xxhash64(*_own(order)), F.lit(1 << 30)) * F.greatest(rows, F.lit(1)) \
        <= F.lit(want << 30)
    fields = lambda s: [s[n] for n in _names(order)]
    by_order = lambda x, y: (F.when(_not_after(order, fields(x), fields(y)),
                                    F.when(_not_after(order, fields(y), fields(x)), 0).otherwise(-1))
                             .otherwise(1))
    sample = keys.filter(below).agg(F.array_sort(F.collect_list("_k"), by_order)
                                    .alias("s"))
    return sample.select(F.filter("s", lambda _, i: i % F.greatest(
        F.floor(F.size("s") / buckets).cast("int"), F.lit(1)) == 0).alias("bounds"))


def with_bucket(df: DataFrame, bounds: DataFrame, order: Sequence[Key], buckets: int,
                name: str) -> DataFrame:
    """Adds ``_k``, the keys of each row, and its bucket, the number of bounds not after them.
    Rows and bounds are each read in one place of one expression, so that Spark evaluates
    the subquery there and no row ever holds a copy of the array."""
    steps = F.array(*[F.lit(1 << b) for b in range((2 * buckets * PER_BUCKET).bit_length() - 1, -1, -1)])
    fields = lambda s: [s[n] for n in _names(order)]

    def found(p: Column) -> Column:
        def step(at: Column, width: Column) -> Column:
            reached = F.transform(F.array(F.try_element_at(p["bounds"], at + width)), lambda b: F.when(
                b.isNull(), False).otherwise(_not_after(order, fields(b), fields(p["row"]["_k"]))))
            return F.when(reached[0], at + width).otherwise(at)
        return F.struct(p["row"].alias("row"), F.aggregate(steps, F.lit(0), step).alias("bucket"))

    both = (df.select(F.struct(*[F.col(c) for c in df.columns if c != "_k"], _key(order)).alias("row"))
            .withColumn("bounds", bounds.scalar()))
    out = both.select(F.transform(F.array(F.struct("row", "bounds")), found)[0].alias("_found"))
    return out.select("_found.row.*", F.col("_found.bucket").alias(name))


def with_position(df: DataFrame, order: Sequence[Key], name: str = "pos", start: int = 1,
                  keys: DataFrame | None = None) -> DataFrame:
    """``df`` with each row's position. ``keys``: rows with the same order keys that are
    cheaper to compute than ``df`` (a projection of the table the keys come from)."""
    buckets = bucket_count(df)
    ks = _keys(df if keys is None else keys, order)
    bounds, packed = order_bounds(ks, order, buckets), _of_key(order)
    rows = with_bucket(df, bounds, order, buckets, "_bucket")
    counts = with_bucket(ks, bounds, packed, buckets, "_bucket").groupBy("_bucket").agg(
        F.count(F.lit(1)).alias("_n"))
    # one row per bucket: bounded by MAX_BUCKETS x PER_BUCKET
    earlier = Window.orderBy("_pos_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(F.col("_bucket").alias("_pos_bucket"), "_n").select(
        "_pos_bucket", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_bucket").orderBy(*[_sort(k, c) for k, c in zip(order, _own(order))])
    return (rows.withColumn("_rn", F.row_number().over(inside))
            # every bucket has its row; an inner join would work the bucket out twice
            .join(F.broadcast(offsets), F.col("_bucket") == F.col("_pos_bucket"), "left")
            .select(*df.columns, (F.col("_rn") + F.col("_before") + F.lit(start - 1))
                    .cast("long").alias(name)))


def _sort(key: Key, value: Column) -> Column:
    return Key(value, key.descending).sort()


def position_in_group(df: DataFrame, group: Sequence[str], order: Sequence[Key],
                      name: str = "pos") -> DataFrame:
    """Dense 1-based position inside each group for every row.

    Buckets cut the order (group, order), so a hot group is dealt to several. A group's
    rows of earlier buckets are added up per (group, bucket); only a group that goes on
    from the bucket before has any, at most one a bucket, so these are broadcast.
    """
    whole = [asc(g) for g in group] + list(order)
    buckets = bucket_count(df)
    ks = _keys(df, whole)
    n = len(group)
    gs = [f"_g{i}" for i in range(n)]
    bounds, packed = order_bounds(ks, whole, buckets), _of_key(whole)
    rows = with_bucket(df, bounds, whole, buckets, "_bucket")
    parts = (with_bucket(ks, bounds, packed, buckets, "_bucket")
             .groupBy("_bucket", *[c.alias(g) for c, g in zip(_own(whole), gs)])
             .agg(F.count(F.lit(1)).alias("_n")))
    earlier = Window.partitionBy(*gs).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    goes_on = (parts.withColumn("_before", F.sum("_n").over(earlier)).filter("_before > 0")
               .select(F.col("_bucket").alias("_b"), "_before", *gs))
    inside = Window.partitionBy("_bucket", *_own(whole)[:n]).orderBy(
        *[_sort(k, c) for k, c in list(zip(whole, _own(whole)))[n:]])
    same = reduce(lambda a, b: a & b, [c.eqNullSafe(F.col(g)) for c, g in zip(_own(whole), gs)],
                  F.col("_bucket") == F.col("_b"))
    return (rows.withColumn("_rn", F.row_number().over(inside))
            .join(F.broadcast(goes_on), same, "left")
            .select(*df.columns, (F.col("_rn") + F.coalesce("_before", F.lit(0))).cast("long").alias(name)))


def top_k_per_group(df: DataFrame, group: Sequence[str], order: Sequence[Column], k: int,
                    name: str = "rn") -> DataFrame:
    """First k rows of each group. The filter on row_number lets Spark insert a
    partial WindowGroupLimit before the shuffle, so at most k rows per group
    and map task are shuffled even for a hot group."""
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w).cast("long")).filter(F.col(name) <= k)


def top_k(df: DataFrame, order: Sequence[Column], k: int) -> DataFrame:
    """Global top-k: TakeOrderedAndProject keeps k rows per partition."""
    return df.orderBy(*order).limit(k)
