"""I-Match document fingerprints with randomised lexicons (operator 10).

Terms are kept whose inverse document frequency lies in a band: neither so common that
every document has them nor so rare that one typing error changes the set. Each of
several random subsets of that lexicon gives one hash of a document's sorted distinct
terms in it; a fingerprint is those hashes, and the likeness of two fingerprints the
share of subsets on which they agree. Subsets come in ``FAMILIES``; within one, each
rate's subset is half of the one before. Short and long documents both have some that are
small enough to survive an edit.

DataFrame functions only. Terms stand for themselves by 64-bit hashes, in whose order they
are sorted. The lexicon is one row, an array of hash buckets read by a scalar subquery: a
term in at least ``lo`` of N documents is one of at most (mean distinct terms of a
document) / lo. Beyond ``MAX_LEXICON`` terms no row holds it: the texts' terms are joined
with it instead.
Documents and their successors meet in buckets of the order of (doc_id, hash of the text),
each of which also gets a copy of the next bucket's first document, so whole texts are
shuffled once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parkops.llm.common import written
from parkops.operators import ranking as R

#: Document frequencies kept, as shares of the documents.
LO, HI = 0.002, 0.3
#: Families of subsets; a family's subsets keep one lexicon term in 2**8, 2**7, .. 2**3 each.
FAMILIES, RATES = 16, (3, 4, 5, 6, 7, 8)
#: Fewer band terms than this, and all terms of the text take part.
FEW = 4
#: Terms of a lexicon that one row holds; a larger one is joined.
MAX_LEXICON = 500_000
#: Hash buckets of the lexicon; documents per bucket of the order.
CELLS, RANGE_DOCS = 1 << 14, 1024
_BREAKS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def terms(text: Column) -> Column:
    """Hashes of the distinct lower-cased runs of letters, digits and what is not ASCII, of
    2 to 40 characters."""
    runs = F.filter(F.split(F.lower(text), _BREAKS), lambda t: F.length(t).between(2, 40))
    return F.array_distinct(F.transform(runs, lambda t: F.xxhash64(t)))


def lexicon(docs: DataFrame, lo: float = LO, hi: float = HI) -> DataFrame:
    """(h): the hashes of the band's terms, counted over all texts."""
    n = docs.count()
    counts = docs.select(F.explode(terms(F.col("text"))).alias("h")).groupBy("h").count()
    return written(counts.filter((F.col("count") >= max(2, lo * n)) & (F.col("count") <= hi * n))
                   .select("h"), "lexicon")


def _in_cells(band: DataFrame) -> DataFrame:
    """One row: an array of ``CELLS`` arrays with the hashes of a lexicon."""
    cells = band.groupBy(F.pmod("h", F.lit(CELLS)).alias("c")).agg(F.collect_list("h").alias("hs"))
    every_cell = band.sparkSession.range(CELLS).select(F.col("id").alias("c")).join(cells, "c", "left")
    none = F.array().cast("array<bigint>")
    return written(every_cell.groupBy().agg(F.transform(
        F.array_sort(F.collect_list(F.struct("c", F.coalesce("hs", none).alias("hs")))),
        lambda x: x["hs"]).alias("lex")), "lexicon-cells")


def _with_found(rows: DataFrame, band: DataFrame) -> DataFrame:
    """``rows`` with the terms of text and edited that a lexicon of any size has, as ``lex``."""
    rows = written(rows.withColumn("_r", F.monotonically_increasing_id()), "fingerprint-rows")
    used = rows.select("_r", F.explode(F.array_union(
        terms(F.col("text")), terms(F.col("edited")))).alias("h"))
    # Spark sizes exploded rows as one each, so a broadcast is ruled out
    found = (used.join(band.hint("merge"), "h", "left_semi").groupBy("_r")
             .agg(F.collect_list("h").alias("lex")))
    none = F.array().cast("array<bigint>")
    return rows.join(found.hint("merge"), "_r", "left").withColumn("lex", F.coalesce("lex", none))


def _prints(found: Column) -> Column:
    """The hash of each subset of sorted terms, '-' of an empty one. A family draws bits for
    each term; the subset of rate r has the terms whose first r bits are 0."""
    def subset(own: Column, family: Column, rates: tuple[int, ...]) -> Column:
        if not rates:
            return F.array().cast("array<string>")
        kept = F.filter(own, lambda h: F.xxhash64(h, family).bitwiseAND(F.lit((1 << rates[0]) - 1)) == 0)
        own_print = lambda s: F.when(F.size(s) == 0, F.lit("-")).otherwise(
            F.lower(F.substring(F.hex(F.xxhash64(s)), 1, 8)))
        return F.transform(F.array(kept), lambda s: F.concat(
            F.array(own_print(s)), subset(s, family, rates[1:])))[0]

    return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(FAMILIES - 1)),
                                 lambda family: subset(found, family, RATES)))


def likeness(a: Column, b: Column) -> Column:
    """Share of the subsets in which either document has terms on which both agree."""
    pairs = F.arrays_zip(a.alias("a"), b.alias("b"))
    same = F.size(F.filter(pairs, lambda p: (p["a"] == p["b"]) & (p["a"] != "-")))
    some = F.size(F.filter(pairs, lambda p: (F.coalesce(p["a"], F.lit("-")) != "-")
                           | (F.coalesce(p["b"], F.lit("-")) != "-")))
    return F.when(a == b, F.lit(1.0)).otherwise(
        F.when(some > 0, same / some).otherwise(F.lit(0.0)))


def _with_next(docs: DataFrame, range_docs: int) -> DataFrame:
    """(_b, _halo, doc_id, text, _h, next): every document with the next one's text by
    (doc_id, hash), null ids last (after the last: the first), in buckets that can be windowed
    alone. Rows equal in both have equal texts, so their order doesn't matter."""
    docs = docs.withColumn("_h", F.xxhash64("text"))
    order = [R.asc(F.col("doc_id").isNull()), R.asc("doc_id"), R.asc("_h")]
    buckets = max(2, min(R.MAX_BUCKETS, -(-docs.count() // range_docs)))
    keys = written(R._keys(docs, order), "fingerprint-keys")
    bounds = R.order_bounds(keys, order, buckets)
    rows = R.with_bucket(docs, bounds, order, buckets, "_b").drop("_k")
    # a bucket's first document also goes to the bucket before it, the very first one to
    # the last: at most one row per bucket
    firsts = (R.with_bucket(keys, bounds, R._of_key(order), buckets, "_b").groupBy("_b")
              .agg(F.min("_k").alias("_first")))
    by_bucket = Window.orderBy("_b")
    last = F.max("_b").over(Window.partitionBy())
    halo = firsts.select(F.col("_first.k1").alias("_id"), F.col("_first.k2").alias("_hash"),
                         F.coalesce(F.lag("_b").over(by_bucket), last).alias("_to"))
    copies = (docs.join(F.broadcast(halo), docs["doc_id"].eqNullSafe(halo["_id"])
                        & (docs["_h"] == halo["_hash"]))
              .groupBy("_to", "_h").agg(F.first("doc_id").alias("doc_id"), F.first("text").alias("text"))
              .select("doc_id", "text", "_h", F.col("_to").alias("_b"), F.lit(True).alias("_halo")))
    every = rows.withColumn("_halo", F.lit(False)).unionByName(copies)
    return every.withColumn("next", F.lead("text").over(_in_bucket()))


def _in_bucket():
    return Window.partitionBy("_b").orderBy("_halo", F.col("doc_id").asc_nulls_last(), "_h")


def fingerprints(docs: DataFrame, lo: float = LO, hi: float = HI,
                 range_docs: int = RANGE_DOCS) -> DataFrame:
    """Per document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next.

    The edited text has its last floor(n_chars / 2) code points replaced by as many of
    the next document's first (or all of them), by ascending doc_id; null ids come last,
    repeated ids in the order of their texts' hashes. Null text: empty. Texts of fewer than
    ``FEW`` band terms use all their terms; a text without terms is fingerprinted by its own
    hash. Equal texts have equal fingerprints. Other columns are not read. A long text is one
    row, whose terms are held at once.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.coalesce(F.col("text"), F.lit("")).alias("text"))
    band = lexicon(docs, lo, hi)
    rows = _with_next(docs, range_docs)
    edited = F.concat(F.expr("substring(text, 1, length(text) - cast(floor(length(text) / 2) as int))"),
                      F.expr("substring(next, 1, cast(floor(length(text) / 2) as int))"))
    rows = rows.select("_b", "_halo", "doc_id", "_h", F.length("text").cast("long").alias("n_chars"),
                       "text", F.coalesce(edited, F.col("text")).alias("edited"))
    cols = rows.columns
    # both texts and the lexicon are read in one expression: no row holds the lexicon
    if band.count() <= MAX_LEXICON:
        rows = rows.withColumn("lex", _in_cells(band).scalar())
        inside = lambda lex, ts: F.filter(ts, lambda h: F.array_contains(
            F.element_at(lex, (F.pmod(h, F.lit(CELLS)) + 1).cast("int")), h))
    else:
        rows = _with_found(rows, band)
        inside = lambda lex, ts: F.array_intersect(ts, lex)

    def prints(p: Column) -> Column:
        def one(side: Column) -> Column:
            every = terms(side)
            some = F.transform(F.array(every), lambda ts: F.struct(
                ts.alias("all"), inside(p["lex"], ts).alias("in")))
            used = F.transform(some, lambda x: F.array_sort(
                F.when(F.size(x["in"]) < FEW, x["all"]).otherwise(x["in"])))
            return F.transform(used, lambda ts: F.when(
                F.size(ts) == 0, F.array(F.concat(F.lit("="), F.md5(side)))).otherwise(_prints(ts)))[0]
        return F.struct(p["row"].alias("row"), F.transform(
            F.array(p["row"]["text"], p["row"]["edited"]), one).alias("fps"))

    both = rows.select(F.struct(*cols).alias("row"), "lex")
    got = both.select(F.transform(F.array(F.struct("row", "lex")), prints)[0].alias("_x")).select(
        "_x.row._b", "_x.row._halo", "_x.row.doc_id", "_x.row._h", "_x.row.n_chars",
        F.sha2("_x.row.edited", 256).alias("edited_sha256"),
        F.col("_x.fps")[0].alias("fp"), F.col("_x.fps")[1].alias("efp"))
    return (got.withColumn("nfp", F.lead("fp").over(_in_bucket())).filter(~F.col("_halo"))
            .select("doc_id", "n_chars", "edited_sha256",
                    F.concat_ws(".", "fp").alias("fingerprint"),
                    F.concat_ws(".", "efp").alias("edited_fingerprint"),
                    likeness(F.col("fp"), F.col("efp")).alias("near_edited"),
                    likeness(F.col("fp"), F.col("nfp")).alias("near_next")))
