"""Removal of repeated passages by sorted suffixes (operator 4).

Every byte is removed that is covered by a string of ``length`` bytes which also starts
in a document with a smaller id. Emitting every suffix would multiply the corpus, so
suffixes start at anchors only: of the ``K``-byte strings inside any window of ``length``
bytes the one with the least hash. Equal windows have equal anchors at equal places, so
no repeat is missed, and a window is judged at its anchors.

1. Anchors whose K bytes occur in one document only are dropped (``blocks.shared_keys``).
2. The others' suffixes, with the bytes that can precede them in a window, are
   range-partitioned by their leading K bytes with sampled splitters. Equal leading bytes
   never straddle a boundary, so nothing has to be compared across it. A block sends an
   equal suffix once, however many copies it holds.
3. Buckets are sorted by multikey quicksort (a word of eight bytes at a time, only ties
   go on); common prefixes of neighbours give the classes of equal windows and each
   class its smallest document. The windows to remove go back to their blocks.
4. Keys with more occurrences than a bucket holds go another way, as one task would get all
   of them: their windows' bytes are grouped for the least document, with partial sums.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from parkops.llm.blocks import Block, in_blocks, joined, shared_keys
from parkops.llm.common import release, tidy, to_batch, written

LENGTH = 50
SEGMENT = 1 << 20
#: Suffixes a bucket holds, about.
BUCKET = 400_000
SPLITTER_BLOCKS = 4096
#: Windows of hot keys that are sorted at once.
SLICE = 1 << 16
#: Occurrences of a key in a block (in one document, in several) that count as a power of two
#: of at least as many; fewer count as 1 and 2.
OFTEN_ONE, OFTEN = 8, 16
#: Owners and occurrences: 1 and 2 as they are, 2 + x is several with 2^x, 100 + x one with 2^x.
CODES = (np.array([0, 1] + [2] * 98 + [1] * 156, np.int64),
         np.array([0, 1, 2] + [1 << min(x, 32) for x in range(1, 98)]
                  + [1 << min(x, 32) for x in range(156)], np.int64))

_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]


def gram(length: int) -> int:
    """Bytes of an anchor; a window has ``length - gram + 1`` of them."""
    if not 4 <= length <= 50:
        raise ValueError("length must be 4 to 50 bytes")
    return min(24, (length + 1) // 2)


def _hashes(data: np.ndarray, k: int, at: np.ndarray | None = None) -> np.ndarray:
    """Hash of the k bytes from each place (or from ``at``) on; k <= 24. ``data`` ends
    with 32 bytes of padding."""
    n = len(data) - 32
    words = np.ndarray((n + 24,), "<u8", buffer=data, strides=(1,))
    h = None
    for j, c in zip(range(0, k, 8), _MIX):
        w = words[j:j + n].copy() if at is None else words[at + j]
        if k - j < 8:
            w &= np.uint64((1 << 8 * (k - j)) - 1)
        h = w if h is None else h + w
        h *= c
        h ^= h >> np.uint64(31)
    return h | np.uint64(1)


def _slide(x: np.ndarray, width: int, f) -> np.ndarray:
    """f over x[i:i + width] for each i (fewer at the end)."""
    out, span = x.copy(), 1
    while span < width:
        move = min(span, width - span)
        out[:-move] = f(out[:-move], out[move:])
        span += move
    return out


def anchors(block: Block, length: int) -> np.ndarray:
    """Places of all anchors of the windows inside documents, ascending."""
    k = gram(length)
    w, n = length - k + 1, len(block.data)
    valid = np.ones(n, bool)
    for a, z in zip(block.starts.tolist(), block.ends.tolist()):
        valid[max(a, z - length + 1):z] = False
    out = []
    for s in range(0, n, SEGMENT):  # memory stays bounded in very long texts
        e = min(n, s + SEGMENT + w)
        h = _hashes(np.concatenate([block.data[s:e + 32], np.zeros(max(0, 32 - max(0, n - e)), np.uint8)]), k)
        h = h[:e - s]
        least = _slide(h, w, np.minimum)
        ok = valid[s:e].copy()
        ok[SEGMENT:] = False  # windows of the next segment
        least[~ok] = 0
        most = _slide(least[::-1], w, np.maximum)[::-1]
        out.append(s + np.flatnonzero(most == h))
    return np.unique(np.concatenate(out)) if out else np.zeros(0, np.int64)


def multikey_order(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, common prefix with the row before) of equally long byte rows: sorted by
    their first eight bytes, runs of ties by the next eight, and so on."""
    n, width = rows.shape
    pad = -width % 8
    words = np.pad(rows, ((0, 0), (0, pad))).view("<u8").byteswap(inplace=True)
    order = np.argsort(words[:, 0], kind="stable")
    tied = np.ones(n, bool)
    for j in range(words.shape[1]):
        key = words[order, j]
        same = np.r_[False, key[1:] == key[:-1]]
        if j:
            same &= run_same
        run_same = same
        if j + 1 == words.shape[1] or not same.any():
            break
        inside = np.flatnonzero(same | np.r_[same[1:], False])
        run = np.cumsum(~same)[inside]
        sub = order[inside]
        order[inside] = sub[np.lexsort((words[sub, j + 1], run))]
    del words
    s = rows[order]
    lcp = np.zeros(n, np.int32)
    if n > 1:
        differ = s[1:] != s[:-1]
        lcp[1:] = np.where(differ.any(1), differ.argmax(1), width)
    return order, lcp


def suffixes(block: Block, at: np.ndarray, length: int) -> np.ndarray:
    """A row per anchor: its bytes and those after it, then those before it in reverse,
    as far as a window reaches. Bytes outside the document are 0xFF, which no text has."""
    k = gram(length)
    r = length - k
    steps = np.concatenate([np.arange(k + r), -1 - np.arange(r)])[None, :]
    out = np.empty((len(at), k + 2 * r), np.uint8)
    for i in range(0, len(at), 1 << 15):  # the places of all anchors at once are many
        some = at[i:i + (1 << 15)]
        doc = np.searchsorted(block.ends, some, side="right")
        places = steps + some[:, None]
        outside = (places < block.starts[doc][:, None]) | (places >= block.ends[doc][:, None])
        out[i:i + len(some)] = np.where(outside, np.uint8(255), block.data[
            np.clip(places, 0, len(block.data) - 1)])
    return out


def repeated_windows(rows: np.ndarray, docs: np.ndarray, length: int) -> np.ndarray:
    """For each (suffix row, document) a bit o if the window that starts o bytes before
    the anchor also occurs with a smaller document. Rows must hold every occurrence of
    their leading bytes, up to equal rows with larger documents."""
    k = gram(length)
    r = length - k
    order, lcp = multikey_order(rows)
    s, d = rows[order], docs[order]
    same_key = lcp >= k
    run = np.cumsum(~same_key) - 1
    # all rows of one key equal: only documents have to be compared
    equal = lcp >= rows.shape[1]
    run_of = np.logical_and.accumulate
    inside = run_of(s[:, k:k + r] != 255, axis=1).sum(1)  # bytes that follow in the document
    before = run_of(s[:, k + r:] != 255, axis=1).sum(1)   # and precede
    group = np.cumsum(~equal) - 1
    first = np.flatnonzero(~equal)
    least = np.minimum.reduceat(d, first)
    mask = np.zeros(len(rows), np.uint32)
    bits = np.arange(r + 1)
    fits = ((bits <= before[:, None]) & (r - bits <= inside[:, None]))
    late = d > least[group]
    for o in range(r + 1):
        mask[late & fits[:, o]] |= np.uint32(1 << o)
    # one row per distinct suffix goes on, if its key has another
    runs = np.bincount(run[first], minlength=run[-1] + 1)
    part = first[runs[run[first]] > 1]
    if len(part):
        own = least[group[part]]
        sub, key = s[part], run[part]
        # left classes need their own order: key, then the bytes before it
        back, lcl = multikey_order(np.concatenate([sub[:, :k], sub[:, k + r:]], axis=1))
        # rows lie in suffix order already: prefixes shared with the row before
        differ = np.r_[np.ones((1, k + r), bool), sub[1:, :k + r] != sub[:-1, :k + r]]
        lcr = np.where(differ.any(1), differ.argmax(1), k + r)
        lcr[0] = 0
        found = np.zeros(len(part), np.uint32)
        for o in range(r + 1):
            left = np.empty(len(part), np.int64)
            left[back] = np.cumsum(lcl < k + o)
            right = np.cumsum(lcr < length - o)
            ok = np.flatnonzero(fits[part, o])
            if not len(ok):
                continue
            pair = left[ok] * (len(part) + 1) + right[ok]
            by = np.argsort(pair, kind="stable")
            p = pair[by]
            new = np.flatnonzero(np.r_[True, p[1:] != p[:-1]])
            low = np.repeat(np.minimum.reduceat(own[ok][by], new), np.diff(np.r_[new, len(p)]))
            hit = ok[by][low < own[ok][by]]
            found[hit] |= np.uint32(1 << o)
        spread = np.zeros(len(first), np.uint32)
        spread[group[part]] = found
        keep = d == least[group]
        mask[keep] = spread[group[keep]]
    out = np.empty(len(rows), np.uint32)
    out[order] = mask
    return out


class _Sent:
    """A block's suffixes that may repeat elsewhere, each distinct one once, with the
    smallest document; the same however often it is computed."""

    def __init__(self, block: Block, extra: bytes, counts: np.ndarray, length: int,
                 hot: int) -> None:
        at = _places(extra)
        keys, inverse = np.unique(_anchor_hashes(block, at, length), return_inverse=True)
        often = counts >= hot
        #: anchors of hot keys are not sent, their windows are
        self.hot_at = at[often[inverse]] if len(at) else at
        self.at = at[((counts >= 2) & (counts < hot))[inverse]] if len(at) else at
        self.doc = block.docs[np.searchsorted(block.ends, self.at, side="right")] \
            if len(self.at) else np.zeros(0, np.int64)
        rows = suffixes(block, self.at, length) if len(self.at) else np.zeros((0, 1), np.uint8)
        if not len(rows):
            self.rows, self.least, self.row_of = rows, self.doc, np.zeros(0, np.int64)
            return
        order, lcp = multikey_order(rows)
        new = lcp < rows.shape[1]
        first = np.flatnonzero(new)
        self.rows = rows[order[first]]
        self.least = np.minimum.reduceat(self.doc[order], first)
        self.row_of = np.empty(len(rows), np.int64)
        self.row_of[order] = np.cumsum(new) - 1


def _hot_windows(block: Block, at: np.ndarray, length: int) -> Iterator[tuple]:
    """The windows at hot anchors, some at a time: (places, the distinct one of each,
    bytes of the distinct ones, their smallest documents)."""
    doc = np.searchsorted(block.ends, at, side="right")
    starts = []
    for o in range(length - gram(length) + 1):
        fits = (at - o >= block.starts[doc]) & (at - o + length <= block.ends[doc])
        starts.append(at[fits] - o)
    starts = np.unique(np.concatenate(starts)) if len(at) else at
    for i in range(0, len(starts), SLICE):
        some = starts[i:i + SLICE]
        rows = block.data[some[:, None] + np.arange(length)]
        docs = block.docs[np.searchsorted(block.ends, some, side="right")]
        order, lcp = multikey_order(rows)
        new = lcp < length
        first = np.flatnonzero(new)
        of = np.empty(len(some), np.int64)
        of[order] = np.cumsum(new) - 1
        yield some, of, rows[order[first]], np.minimum.reduceat(docs[order], first)


def _masks(parts: list | None) -> np.ndarray:
    """A block's masks in the order of its suffixes."""
    return np.frombuffer(b"".join(zstandard.decompress(p["mask"]) for p in parts or []), "<u4")


def _places(extra: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(zstandard.decompress(extra), "<u4").astype(np.int64)) if extra \
        else np.zeros(0, np.int64)


def _anchor_hashes(block: Block, at: np.ndarray, length: int) -> np.ndarray:
    """Hashes of the anchors' K bytes. Anchors are where ``_hashes`` is least, so most of its
    values are small and a range of them would get many times its share; mixed once more
    (one to one) they fill all ranges alike."""
    data = np.concatenate([block.data, np.zeros(32, np.uint8)])
    h = _hashes(data, gram(length), at)
    h *= _MIX[1]
    h ^= h >> np.uint64(32)
    h *= _MIX[2]
    return h


def dedup(docs: DataFrame, rest: list[str] | None = None, length: int = LENGTH,
          as_text: bool = False, hot_rows: int = BUCKET) -> DataFrame:
    """Per document: doc_id, kept (bytes left, in order), spans (array of start, end:
    maximal removed runs, in bytes of the input), n_bytes, and the columns ``rest``.
    ``as_text``: kept is a string; what a cut left of a character goes too. ``hot_rows``
    (2 to 65535, or more for 65535): counted occurrences from which on a key is hot.

    Strings are judged on the input and never cross documents. Rows that share a doc_id
    are one document to each other (neither removes from the other); a null doc_id counts
    as larger than all others. Null text: empty. Texts of fewer than ``length`` bytes
    stay whole.
    """
    rest = rest or []
    k = gram(length)

    def find(block: Block) -> tuple[bytes, int]:
        at = anchors(block, length)
        gaps = np.diff(at, prepend=0).astype("<u4")
        return (zstandard.compress(gaps.tobytes(), 1) if len(at) else b""), len(at)

    def keys(block: Block, extra: bytes) -> tuple[np.ndarray, np.ndarray]:
        at = _places(extra)
        h = _anchor_hashes(block, at, length)
        doc = block.docs[np.searchsorted(block.ends, at, side="right")] if len(at) else at
        order = np.argsort(h, kind="stable")
        s, d = h[order], doc[order]
        new = np.flatnonzero(np.r_[True, s[1:] != s[:-1]]) if len(s) else np.zeros(0, np.int64)
        if not len(new):
            return s, np.zeros(0, np.int64)
        several = np.minimum.reduceat(d, new) != np.maximum.reduceat(d, new)
        n = np.diff(np.r_[new, len(s)])
        log = np.ceil(np.log2(n)).astype(np.int64)
        return s[new], np.where(several, np.where(n >= OFTEN, log + 2, 2),
                                np.where(n >= OFTEN_ONE, log + 100, 1))

    table = in_blocks(docs, rest, find)
    total = table.agg(F.sum("n_keys")).first()[0] or 0
    counts = shared_keys(table, keys, total, CODES)
    hot = min(max(hot_rows, 2), 65535)
    cuts = np.array(_splitters(table, counts, length, hot), f"S{k}")

    sent = pa.schema([("bucket", pa.int32()), ("block", pa.int64()), ("rows", pa.binary()),
                      ("docs", pa.binary())])

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, docs, lengths, data, extra, counts in zip(*(c.to_pylist() for c in b.columns)):
                own = _Sent(Block(docs, lengths, data), extra, joined(counts, "<u2"), length, hot)
                if not len(own.rows):
                    continue
                lead = np.ascontiguousarray(own.rows[:, :k]).view(f"S{k}")[:, 0]
                edge = [0, *np.searchsorted(lead, cuts, side="left").tolist(), len(lead)]
                yield to_batch([(i, name, zstandard.compress(own.rows[a:z].tobytes(), 3),
                                 zstandard.compress(own.least[a:z].astype("<i8").tobytes(), 1))
                                for i, (a, z) in enumerate(zip(edge, edge[1:])) if z > a], sent)

    def meet(group: pa.Table) -> pa.Table:
        width = k + 2 * (length - k)
        rows = np.frombuffer(b"".join(zstandard.decompress(x.as_py()) for x in group.column("rows")),
                             np.uint8).reshape(-1, width)
        docs = [zstandard.decompress(x) for x in group.column("docs").to_pylist()]
        mask = repeated_windows(rows, np.frombuffer(b"".join(docs), "<i8"), length)
        cut = np.cumsum([0, *(len(d) // 8 for d in docs)]).tolist()
        del rows
        release()
        return pa.table({"block": group.column("block"), "bucket": group.column("bucket"),
                         "mask": pa.array([zstandard.compress(mask[a:z].astype("<u4").tobytes(), 1)
                                           for a, z in zip(cut, cut[1:])])})

    cols = ["block", "docs", "lengths", "data", "extra"]
    masks = (table.select(*cols).join(counts, "block").select(*cols, "counts").mapInArrow(
        tidy(send), "bucket int, block long, rows binary, docs binary")
        .groupBy("bucket").applyInArrow(meet, "block long, bucket int, mask binary"))
    masks = written(masks, "masks").groupBy("block").agg(
        F.sort_array(F.collect_list(F.struct("bucket", "mask"))).alias("mask"))

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("block", pa.int64()), ("i", pa.int64()), ("window", pa.binary()),
                            ("doc", pa.int64())])
        for b in batches:
            for name, docs, lengths, data, extra, counts in zip(*(c.to_pylist() for c in b.columns)):
                block, at = Block(docs, lengths, data), _places(extra)
                _, inverse = np.unique(_anchor_hashes(block, at, length), return_inverse=True)
                often = joined(counts, "<u2") >= hot
                made = 0
                for _, _, rows, least in _hot_windows(block, at[often[inverse]], length):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(rows), name, np.int64)),
                         pa.array(np.arange(made, made + len(rows))),
                         pa.array(rows.view(f"V{length}")[:, 0].tolist(), pa.binary()),
                         pa.array(least)], schema=schema)
                    made += len(rows)

    if (counts.agg(F.max("most")).first()[0] or 0) >= hot:
        # a block sends a window once (or once a slice), so the join meets few rows of one window
        every = written(table.select(*cols).join(counts, "block").select(*cols, "counts").mapInArrow(
            tidy(windows), "block long, i long, window binary, doc long"), "windows")
        least = every.groupBy("window").agg(F.min("doc").alias("least"))
        late = (every.join(least, "window").filter("least < doc").groupBy("block")
                .agg(F.collect_list("i").alias("late")))
        masks = masks.join(late, "block", "full")
    else:
        masks = masks.withColumn("late", F.lit(None).cast("array<bigint>"))

    fields = [f for f in docs.select(*rest).schema] if rest else []
    kept_type = ("string", pa.string()) if as_text else ("binary", pa.binary())
    ddl = StructType.fromDDL(f"doc_id long, kept {kept_type[0]}, "
                             "spans array<struct<start: bigint, end: bigint>>, n_bytes long")
    for f in fields:
        ddl = ddl.add(f.name, f.dataType)

    def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for b in batches:
            for docs, nulls, lengths, data, more, extra, counts, mask, late in zip(
                    *(c.to_pylist() for c in b.columns)):
                block = Block(docs, lengths, data)
                gone = _covered(block, _Sent(block, extra, joined(counts, "<u2"), length, hot),
                                _masks(mask), np.array(late or [], np.int64), length)
                kept, spans = [], []
                for a, z in zip(block.starts.tolist(), block.ends.tolist()):
                    g = gone[a:z]
                    edge = np.flatnonzero(np.diff(np.r_[0, g.view(np.int8), 0])).reshape(-1, 2)
                    left = block.data[a:z][~g] if len(edge) else block.data[a:z]
                    kept.append(left.tobytes().decode("utf-8", "ignore") if as_text
                                else left.tobytes())
                    spans.append([{"start": x, "end": y} for x, y in edge.tolist()])
                no_id = np.unpackbits(np.frombuffer(nulls, np.uint8))[:len(block.docs)].astype(bool)
                arrays = [pa.array(block.docs, mask=no_id), pa.array(kept, kept_type[1]),
                          pa.array(spans, span), pa.array(block.lengths)]
                if more:
                    t = pa.ipc.open_stream(zstandard.decompress(more)).read_all().combine_chunks()
                    arrays += [c.chunk(0) if c.num_chunks else c for c in t.columns]
                names = ["doc_id", "kept", "spans", "n_bytes", *(f.name for f in fields)]
                whole = pa.RecordBatch.from_arrays(arrays, names=names)
                for a in range(0, whole.num_rows, 2048):
                    yield whole.slice(a, 2048)

    return (table.select("block", "docs", "nulls", "lengths", "data", "rest", "extra")
            .join(counts, "block", "left").join(masks, "block", "left")
            .select("docs", "nulls", "lengths", "data", "rest", "extra", "counts", "mask", "late")
            .mapInArrow(tidy(cut_out), ddl))


def _covered(block: Block, own: _Sent, mask: np.ndarray, late: np.ndarray,
             length: int) -> np.ndarray:
    """Which bytes of the block are removed. ``late``: numbers of the windows of hot keys that
    a smaller document of another block has."""
    n, k = len(block.data), gram(length)
    r = length - k
    edges = np.zeros(n + 1, np.int32)
    if len(own.at):
        doc = np.searchsorted(block.ends, own.at, side="right")
        before = np.minimum(own.at - block.starts[doc], r)
        after = np.minimum(block.ends[doc] - own.at - k, r)
        bits = np.arange(r + 1)
        fits = (bits <= before[:, None]) & (r - bits <= after[:, None])
        # a copy in a larger document repeats all of it, the smallest one what was found
        full = own.doc > own.least[own.row_of]
        hit = fits & (full[:, None] | ((mask[own.row_of][:, None] >> bits.astype(np.uint32)) & 1 > 0))
        where, o = np.nonzero(hit)
        starts = np.unique(own.at[where] - o)
        np.add.at(edges, starts, 1)
        np.add.at(edges, starts + length, -1)
    made, late = 0, np.sort(late)
    for starts, of, rows, least in _hot_windows(block, own.hot_at, length):
        doc = block.docs[np.searchsorted(block.ends, starts, side="right")]
        gone = starts[(doc > least[of]) | np.isin(of + made, late)]
        np.add.at(edges, gone, 1)
        np.add.at(edges, gone + length, -1)
        made += len(rows)
    return np.cumsum(edges[:n]) > 0


def _splitters(table: DataFrame, counts: DataFrame, length: int, hot: int) -> list[bytes]:
    """Leading bytes that cut the suffixes which blocks send into buckets of about ``BUCKET``,
    by a bounded sample of the blocks (``SPLITTER_BLOCKS`` about), up to 64 of each."""
    k = gram(length)
    schema = pa.schema([("leads", pa.binary()), ("n", pa.int64())])

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for docs, lengths, data, extra, counts in zip(*(c.to_pylist() for c in b.columns)):
                block, at, times = Block(docs, lengths, data), _places(extra), joined(counts, "<u2")
                _, inverse = np.unique(_anchor_hashes(block, at, length), return_inverse=True)
                at = at[((times >= 2) & (times < hot))[inverse]] if len(at) else at
                if len(at):
                    pick = at[np.linspace(0, len(at) - 1, min(64, len(at))).astype(int)]
                    yield to_batch([(b"".join(block.data[p:p + k].tobytes() for p in pick.tolist()),
                                     len(at))], schema)

    blocks = table.count()
    # by a filter: whole blocks that are sorted for a limit meet in one task
    picked = table if blocks <= SPLITTER_BLOCKS else table.filter(
        F.pmod(F.xxhash64("block"), F.lit(blocks)) < SPLITTER_BLOCKS)
    found = (picked.select("block", "docs", "lengths", "data", "extra").join(counts, "block")
             .select("docs", "lengths", "data", "extra", "counts")
             .mapInArrow(tidy(some), "leads binary, n long").collect())
    if not found:
        return []
    lead = np.frombuffer(b"".join(r.leads for r in found), f"S{k}")
    each = [len(r.leads) // k for r in found]
    order = np.argsort(lead, kind="stable")
    # a lead stands for its share of the block's suffixes
    upto = np.cumsum(np.repeat([r.n / e for r, e in zip(found, each)], each)[order])
    total = upto[-1] * max(1.0, blocks / SPLITTER_BLOCKS)
    buckets = max(64, int(-(-total // BUCKET)))
    at = np.searchsorted(upto, upto[-1] * np.arange(1, buckets) / buckets)
    return [bytes(c) for c in np.unique(lead[order[np.minimum(at, len(lead) - 1)]])]
