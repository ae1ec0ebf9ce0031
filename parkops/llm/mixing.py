"""Mixing sources to target weights (operator 12).

Every source's words form one stream, cut into blocks of ``BLOCK`` words (the last one is
shorter). The mix is a row of slots, each holding one block; slots are dealt to output
shards. A shard draws how many of its slots each source gets: a multinomial draw with the
sources' shares as probabilities. What the draws of all shards give a source beyond its
share goes to sources that got less, so that shares hold exactly and not only on average.
A source's k-th slot takes the block at position k of a pseudorandom permutation of its
blocks, one permutation for each pass over them (a swap-or-not shuffle, exact for any
number of blocks); its last slot is cut where the target is reached. Blocks and slots meet
in one join on (source, block).

DataFrame functions only. Documents are numbered inside a source by sums over hash buckets
of at most about ``BUCKET`` rows, equal rows are folded to one row with their number, and
shards send counts, so no source, key or group of copies has to fit one task. One row per
source (and per source and bucket, per source and shard) passes a window.

Results depend on the rows alone, not on their order or partitioning.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parkops.llm.common import written

#: Words of a block, slots of a shard, rows of a bucket, copies of a row handled together.
BLOCK, SHARD, BUCKET, COPIES = 128, 8192, 8192, 4096
#: No document is taken more often than this.
PASSES = 3
SEED = 20_011
ROUNDS = 20
#: Cells of the table in which a drawn number finds its source.
CELLS = 1024
#: So many sources at most are broadcast; more are joined by salted keys.
MAX_BROADCAST, SALTS = 20_000, 16
STRIDE = 1_000_003
WORD = r"[^\\x20\\x09-\\x0D]++"
P = 2_147_483_647  # a prime; numbers below it can be squared in 64 bits


def scramble(v: str) -> str:
    """SQL of a pseudorandom number below P from one that is not negative."""
    once = f"((({v}) % {P}) * (({v}) % {P}) + 69621 * (({v}) % {P}) + 12345) % {P}"
    return f"(({once}) * 48271 + 11) % {P}"


def wide(v: str) -> str:
    """SQL of a pseudorandom number below 2**61 from one that is not negative."""
    return f"((({scramble(f'({v}) + 77')}) % 1073741824) * 2147483648 + {scramble(f'({v}) * 2 + 5')})"


def round_keys(seed: str) -> str:
    """SQL of a seed's list of round keys; ``r`` is the round."""
    return f"transform(sequence(1L, {ROUNDS}L), r -> {wide(f'({seed}) * 64 + r')})"


def swap_or_not(x: str, k: str, n: str) -> str:
    """SQL of a round of the shuffle of 0..n-1: x or its partner, by a bit of the larger.
    A round undoes itself, so any number of rounds is a permutation."""
    partner = f"(({k} % {n} - {x} + {n}) % {n})"
    bit = f"((greatest({x}, {partner}) % {P}) * ({k} % {P}) % {P}) % 2"
    return f"CASE WHEN {bit} = 1 THEN {partner} ELSE {x} END"


def permuted(x: str, keys: str, n: str) -> Column:
    """The number at position ``x`` of the permutation of 0..n-1 that ``keys`` make (with
    the keys in reverse: the position of number ``x``)."""
    return F.expr(f"aggregate({keys}, cast({x} AS bigint), (x, k) -> {swap_or_not('x', 'k', n)})")


def targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size, s, weight, target) of (source, source_size): shares of all
    words by weights 1, 2, 3, 1, ... in code-point order (null last), each at most
    ``PASSES`` times the source's words; what is cut is shared out again by weight until
    no share is above. With the sources in order of the share at which they are full, the
    full ones come first, so running sums find them all at once."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    every = Window.partitionBy()
    full = Window.orderBy("_fill", "s")
    before = full.rowsBetween(Window.unboundedPreceding, -1)
    cap = (F.col("source_size") * PASSES).cast("double")
    t = (sizes.withColumn("s", F.row_number().over(by_name).cast("long") - 1)
         .withColumn("weight", F.col("s") % 3 + 1)
         .withColumn("_all", F.sum("source_size").over(every).cast("double"))
         .withColumn("_cap", cap).withColumn("_fill", cap / F.col("weight"))
         .withColumn("_left", F.col("_all") - F.coalesce(F.sum("_cap").over(before), F.lit(0.0)))
         .withColumn("_weights", F.sum("weight").over(every)
                     - F.coalesce(F.sum("weight").over(before), F.lit(0)))
         .withColumn("_full", F.col("_fill") * F.col("_weights") <= F.col("_left")))
    t = (t.withColumn("_rest", F.col("_all") - F.coalesce(
            F.sum(F.when(F.col("_full"), F.col("_cap"))).over(every), F.lit(0.0)))
         .withColumn("_open", F.sum(F.when(~F.col("_full"), F.col("weight"))).over(every)))
    share = F.when(F.col("_full"), F.col("_cap")).otherwise(
        F.col("weight") * F.col("_rest") / F.col("_open"))
    return t.select("source", "source_size", "s", "weight", share.alias("target"))


def quotas(shares: DataFrame, block: int) -> DataFrame:
    """Adds per source: blocks (their number), keys (of the permutation of each pass), quota
    (its slots), last_take (words that the last slot takes). Whole passes take every block; the last pass goes on until the
    target is reached, where its shorter block may come early (``_short``: its place)."""
    B = F.lit(block).cast("long")
    ceil_div = lambda a: F.floor((a + (B - 1)) / B).cast("long")
    keys = ", ".join(round_keys(f"{SEED} + s * {PASSES + 1} + {e}") for e in range(PASSES + 1))
    q = (shares.withColumn("blocks", ceil_div(F.col("source_size")))
         .withColumn("keys", F.expr(f"array({keys})"))
         .withColumn("_words", F.least(F.round("target").cast("long"), F.col("source_size") * PASSES))
         .withColumn("_passes", F.when(F.col("source_size") > 0, F.expr("_words div source_size")).otherwise(0))
         .withColumn("_r", F.col("_words") - F.col("_passes") * F.col("source_size"))
         .withColumn("_missing", F.col("blocks") * B - F.col("source_size"))
         .withColumn("_short", F.when(F.col("_r") > 0, permuted(
             "blocks - 1", "reverse(keys[cast(_passes AS int)])", "blocks")))
         .withColumn("_early", F.col("_short") < ceil_div(F.col("_r")))
         .withColumn("_m", ceil_div(F.col("_r") + F.when(F.col("_early"), F.col("_missing")).otherwise(0))))
    done = (F.col("_m") - 1) * B - F.when(F.col("_m") - 1 > F.col("_short"), F.col("_missing")).otherwise(0)
    return (q.withColumn("quota", F.col("_passes") * F.col("blocks")
                         + F.when(F.col("_r") > 0, F.col("_m")).otherwise(0))
            .withColumn("last_take", F.when(F.col("_r") > 0, F.col("_r") - done).otherwise(B))
            .select(*shares.columns, "blocks", "keys", "quota", "last_take"))


def _intervals(df: DataFrame, size: str, lo: str, *keep: str) -> DataFrame:
    """(keep, lo, hi): the rows' sizes laid end to end by s."""
    before = Window.orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(lo, F.coalesce(F.sum(size).over(before), F.lit(0)).cast("long")).select(
        *keep, lo, (F.col(lo) + F.col(size)).alias("hi"))


def _find(points: DataFrame, at: str, spans: DataFrame, lo: str, total: int) -> DataFrame:
    """Points with the span [lo, hi) each lies in, by an equi-join on cells of the range."""
    width = max(1, -(-total // CELLS))
    cells = (spans.filter(F.col("hi") > F.col(lo))
             .withColumn("_cell", F.explode(F.sequence(F.expr(f"{lo} div {width}"),
                                                       F.expr(f"(hi - 1) div {width}")))))
    return (points.withColumn("_cell", F.expr(f"{at} div {width}")).join(cells, "_cell")
            .filter((F.col(at) >= F.col(lo)) & (F.col(at) < F.col("hi"))).drop("_cell"))


def draw_slots(src: DataFrame, block: int, shard: int) -> DataFrame:
    """(shard, place, s, k, epoch, block, take): every slot of the mix, k its number in its
    source, place its position in its shard. ``src`` is a written table of quotas()."""
    spark = src.sparkSession
    total = src.agg(F.coalesce(F.sum("quota"), F.lit(0)).cast("long")).first()[0]
    tasks = max(1, min(-(-total // (shard * 4)), 10_000))
    drawn = _find(
        spark.range(0, total, 1, tasks).select(
            F.expr(f"id div {shard}").alias("shard"),
            F.expr(f"({wide(f'id + {SEED}')}) % {max(1, total)}").alias("_v")),
        "_v", _intervals(src, "quota", "_lo", "s"), "_lo", total)
    # the multinomial counts of each shard; a source's slots are numbered over its shards
    earlier = Window.partitionBy("s").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy("shard").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    counts = written(drawn.groupBy("shard", "s").agg(F.count(F.lit(1)).alias("n")), "mix-counts")
    numbered = (counts
                .withColumn("_k", F.coalesce(F.sum("n").over(earlier), F.lit(0)).cast("long"))
                .withColumn("_at", F.coalesce(F.sum("n").over(inside), F.lit(0)).cast("long"))
                .withColumn("_in", F.sum("n").over(Window.partitionBy("shard")).cast("long")))
    slots = (numbered.withColumn("_i", F.explode(F.expr("sequence(0L, n - 1)")))
             .select("shard", "s", (F.col("_k") + F.col("_i")).alias("k"),
                     (F.col("_at") + F.col("_i")).alias("_at"), "_in"))
    # settle: slots above a source's quota, numbered over all sources, fill those below
    got = src.select("s", "quota").join(
        counts.groupBy("s").agg(F.sum("n").cast("long").alias("_got")), "s", "left").fillna(0, ["_got"])
    got = written(got.withColumn("_over", F.greatest(F.col("_got") - F.col("quota"), F.lit(0)))
                  .withColumn("_under", F.greatest(F.col("quota") - F.col("_got"), F.lit(0))), "mix-drawn")
    moved = got.agg(F.coalesce(F.sum("_over"), F.lit(0)).cast("long")).first()[0]
    over = _intervals(got, "_over", "_first", "s", "quota").drop("hi")
    under = _intervals(got, "_under", "_to", "s", "_got").select(
        F.col("s").alias("_s"), F.col("_got").alias("_base"), "_to", "hi")
    known = _sources(slots, over)
    kept = known.filter("k < quota").select("shard", "_at", "_in", "s", "k")
    dealt = _find(known.filter("k >= quota").withColumn("_j", F.expr("_first + k - quota")),
                  "_j", under, "_to", moved)
    every = kept.unionByName(dealt.select("shard", "_at", "_in", F.col("_s").alias("s"),
                                          F.expr("_base + _j - _to").alias("k")))
    return (_sources(every, src.select("s", "blocks", "keys", "quota", "last_take"))
            .withColumn("epoch", F.expr("k div blocks"))
            .withColumn("block", permuted("k % blocks", "keys[cast(epoch AS int)]", "blocks"))
            # the stride is a prime above any shard's size: every place comes once
            .select("shard", F.expr(f"(_at * {STRIDE} + {scramble('shard')}) % _in").alias("place"),
                    "s", "k", "epoch", "block",
                    F.when(F.col("k") == F.col("quota") - 1, F.col("last_take"))
                    .otherwise(F.lit(block).cast("long")).alias("take")))


def _sources(rows: DataFrame, src: DataFrame) -> DataFrame:
    """``rows`` with the columns of their source: few sources are broadcast; with many,
    the keys are salted so that a source's rows are dealt to several tasks."""
    if src.count() <= MAX_BROADCAST:
        return rows.join(F.broadcast(src), "s")
    salted = src.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    spread = rows.withColumn("_salt", F.pmod(F.xxhash64(*rows.columns), F.lit(SALTS)).cast("int"))
    return spread.join(salted, ["s", "_salt"]).drop("_salt")


def bucket_of(doc_id: str, size: str, chunk: str, n: str) -> str:
    return (f"({wide(f'(coalesce({doc_id}, 3) % {P} + {P}) % {P} + ({size}) * 131 + ({chunk}) * 31')})"
            f" % ({n})")


def doc_pieces(docs: DataFrame, src: DataFrame, n_docs: int, block: int, bucket: int) -> DataFrame:
    """(s, doc_id, size, start, copy, block, off, words): the parts of every document in
    the blocks of its source's stream. A document without words has one row, block null."""
    # null sources meet under a flag, so that both joins are on plain keys
    key = [F.coalesce("source", F.lit("")).alias("_source"), F.col("source").isNull().alias("_none")]
    known = src.select("s", *key)
    keyed = docs.select("doc_id", "size", *key)
    if known.count() <= MAX_BROADCAST:
        keyed = keyed.join(F.broadcast(known), ["_source", "_none"])
    else:
        known = known.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        keyed = (keyed.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "size"), F.lit(SALTS)).cast("int"))
                 .join(known, ["_source", "_none", "_salt"]))
    folded = keyed.groupBy("s", "doc_id", "size").agg(F.count(F.lit(1)).alias("_all"))
    buckets = max(1, -(-n_docs // bucket))
    rows = (folded.withColumn("chunk", F.explode(F.expr(f"sequence(0L, (_all - 1) div {COPIES})")))
            .withColumn("copies", F.least(F.lit(COPIES), F.col("_all") - F.col("chunk") * COPIES))
            .withColumn("bucket", F.expr(bucket_of("doc_id", "size", "chunk", str(buckets))))
            .withColumn("_w", F.col("size") * F.col("copies")))
    before = Window.partitionBy("s").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = (rows.groupBy("s", "bucket").agg(F.sum("_w").alias("_sum"))
             .select("s", "bucket", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base")))
    within = (Window.partitionBy("s", "bucket")
              .orderBy(F.col("doc_id").asc_nulls_last(), "size", "chunk")
              .rowsBetween(Window.unboundedPreceding, -1))
    placed = (rows.withColumn("_before", F.coalesce(F.sum("_w").over(within), F.lit(0)))
              .join(bases, ["s", "bucket"])
              .withColumn("_i", F.explode(F.expr("sequence(0L, copies - 1)")))
              .select("s", "doc_id", "size",
                      (F.col("_base") + F.col("_before") + F.col("_i") * F.col("size"))
                      .cast("long").alias("start"),
                      (F.col("chunk") * COPIES + F.col("_i")).alias("copy")))
    spans = F.when(F.col("size") > 0, F.expr(f"sequence(start div {block}, (start + size - 1) div {block})"))
    first = F.greatest(F.col("start"), F.col("block") * block)
    return (placed.withColumn("block", F.explode_outer(spans))
            .withColumn("off", first - F.col("block") * block)
            .withColumn("words", F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * block) - first))


class Mix(NamedTuple):
    """sources: quotas() of every source; pieces: doc_pieces(); slots: draw_slots()."""

    sources: DataFrame
    pieces: DataFrame
    slots: DataFrame
    block: int


def mix(docs: DataFrame, block: int = BLOCK, shard: int = SHARD, bucket: int = BUCKET) -> Mix:
    """Mix documents (doc_id, text, source) to their sources' target weights.

    Null texts have no words; a null source is a source of its own, the last; null and
    repeated doc_ids are documents like others (equal rows are interchangeable). Other
    columns are not read. Without any word, every target and every taken count is 0.
    """
    sized = written(docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), "source",
        F.coalesce(F.expr(f"regexp_count(text, '{WORD}')"), F.lit(0)).cast("long").alias("size")),
        "mix-sizes")
    sizes = sized.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    src = written(quotas(targets(sizes), block), "mix-sources")
    return Mix(src, doc_pieces(sized, src, sized.count(), block, bucket), draw_slots(src, block, shard), block)


def stream(m: Mix) -> DataFrame:
    """The mix itself, (shard, place, source, epoch, block, off, doc_id, copy, doc_from,
    words): which words (doc_from: the first one's number in its document) of which
    documents stand in which slot, in order of off."""
    taken = F.least(F.col("off") + F.col("words"), F.col("take")) - F.col("off")
    return (_sources(m.slots.join(m.pieces, ["s", "block"]), m.sources.select("s", "source"))
            .withColumn("words", taken).filter("words > 0")
            .withColumn("doc_from", F.col("block") * m.block + F.col("off") - F.col("start"))
            .select("shard", "place", "source", "epoch", "block", "off", "doc_id", "copy",
                    "doc_from", "words"))


def taken(m: Mix) -> DataFrame:
    """Per document: doc_id, size, source_size, target, taken (words the mix takes of it)."""
    whole = F.col("take") == m.block
    uses = m.slots.groupBy("s", "block").agg(
        F.sum(F.when(whole, 1).otherwise(0)).alias("_n"),
        F.max(F.when(~whole, F.col("take"))).alias("_cut"))
    cut = F.greatest(F.least(F.col("off") + F.col("words"), F.col("_cut")) - F.col("off"), F.lit(0))
    words = (F.coalesce(F.col("_n") * F.col("words"), F.lit(0))
             + F.when(F.col("_cut").isNotNull() & (F.col("words") > 0), cut).otherwise(0))
    per_doc = (m.pieces.join(uses, ["s", "block"], "left")
               .groupBy("s", "doc_id", "size", "start", "copy")
               .agg(F.sum(words).cast("long").alias("taken")))
    return (_sources(per_doc, m.sources.select("s", "source_size", "target"))
            .select("doc_id", "size", "source_size", "target", "taken"))
