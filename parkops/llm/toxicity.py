"""Toxicity scores (operator 7).

A lexicon of terms and word stems is learned from labelled documents and kept as a
trie. Words within a bounded edit distance of a term are found by the Levenshtein
automaton intersected with the trie: the product is one deterministic automaton, built
lazily, that reads a word once. The words around each hit then tell quotation (quotes,
words of reporting) from abuse (direct address, several hits close together), and a
logistic model weighs the counts.

Only bounded things reach the driver: at most ``MAX_TERMS`` terms with their counts and
one row of ``FEATURES`` for at most ``MAX_LABELLED`` labelled documents.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parkops.llm.common import id_text, map_rows, only, small_batches

#: Labelled training documents used at most (the first by a hash of their id).
MAX_LABELLED = 50_000
#: Independent hash functions on which near copies agree, for the lexicon.
SKETCH = 2
MAX_TERMS = 2_000
#: A term must be in this many toxic training documents, and so sure a sign of them.
MIN_DOCS, MIN_SHARE = 5, 0.9
STEM = (4, 12)
WINDOW = 8

FEATURES = ("direct", "quoted", "fuzzy", "stem", "dense", "address")

_WORD = re.compile(r"[^\W_][\w'’-]*")
_QUOTES = "\"“”„«»‘‹›`"
#: Words near a hit that report or mention, and that address someone.
_REPORT = frozenset("said says called quote quoted word term phrase insult slur meaning means "
                    "wrote written sagte nannte wort begriff zitat dit appelé mot terme dijo "
                    "llamó palabra término".split())
_ADDRESS = frozenset("you your you're youre u ur du dich dein deine ihr sie tu te toi ton vous "
                     "votre tú usted eres ti".split())


class LexiconAutomaton:
    """Trie of terms x Levenshtein automaton, determinised while it reads.

    A state is a set of (trie node, edits used); a term of n characters allows n // 5
    edits, two at most. Stems match every word that begins with them, without edits
    under six characters. ``match`` gives 0: none, 1: exact, 2: misspelled, 3: stem.
    """

    def __init__(self, terms: list[str], stems: list[str]) -> None:
        self.child: list[dict[str, int]] = [{}]
        self.closed: dict[int, int] = {}  # node -> edits allowed
        self.open: dict[int, int] = {}
        self.allow = [0]
        for t in terms:
            self._add(t, min(2, len(t) // 5), self.closed)
        for s in stems:
            self._add(s, 1 if len(s) >= 7 else 0, self.open)
        self.states: dict[frozenset, int] = {}
        self.members: list[frozenset] = []
        self.next: list[dict[str, int]] = []
        self.ends: list[int] = []
        self.sticky: list[bool] = []
        self.start = self._state(self._close({0: 0}))

    def _add(self, term: str, edits: int, ends: dict[int, int]) -> None:
        node = 0
        self.allow[0] = max(self.allow[0], edits)
        for c in term:
            at = self.child[node].get(c)
            if at is None:
                at = self.child[node][c] = len(self.child)
                self.child.append({})
                self.allow.append(0)
            node = at
            self.allow[node] = max(self.allow[node], edits)
        ends[node] = max(ends.get(node, 0), edits)

    def _close(self, at: dict[int, int]) -> dict[int, int]:
        """Adds what is reached by leaving out characters of the term."""
        todo = list(at.items())
        while todo:
            node, e = todo.pop()
            if at.get(node, 9) < e:
                continue
            for child in self.child[node].values():
                if e + 1 <= self.allow[child] and at.get(child, 9) > e + 1:
                    at[child] = e + 1
                    todo.append((child, e + 1))
        return at

    def _state(self, at: dict[int, int]) -> int:
        key = frozenset(at.items())
        if key not in self.states:
            self.states[key] = len(self.members)
            self.members.append(key)
            self.next.append({})
            hits = [e for n, e in at.items() if e <= self.closed.get(n, -1)]
            self.ends.append(0 if not hits else 1 if min(hits) == 0 else 2)
            self.sticky.append(any(e <= self.open.get(n, -1) for n, e in at.items()))
        return self.states[key]

    def _step(self, state: int, c: str) -> int:
        out: dict[int, int] = {}
        for node, e in self.members[state]:
            reached = [(child, e + (ch != c)) for ch, child in self.child[node].items()]
            for n, d in [*reached, (node, e + 1)]:
                if d <= self.allow[n] and out.get(n, 9) > d:
                    out[n] = d
        to = self.next[state][c] = self._state(self._close(out)) if out else -1
        return to

    def match(self, word: str) -> int:
        s, stem = self.start, 0
        for c in word:
            to = self.next[s].get(c)
            if to is None:
                to = self._step(s, c)
            if to < 0:
                return stem
            s = to
            if self.sticky[s]:
                stem = 3
        return self.ends[s] or stem


class Scorer(dict):
    """Kind of match by word, kept for frequent words; features and scores of texts."""

    KEEP = 100_000

    def __init__(self, terms: list[str], stems: list[str]) -> None:
        self.automaton = LexiconAutomaton(terms, stems)

    def __missing__(self, word: str) -> int:
        kind = self.automaton.match(word)
        if len(self) < self.KEEP:
            self[word] = kind
        return kind

    def features(self, text: str | None) -> list[float]:
        if not text:
            return [0.0] * len(FEATURES)
        low = text.lower()
        # distinct words first: most texts have no hit and need no positions
        if not any(map(self.__getitem__, set(_WORD.findall(low)))):
            return [0.0] * len(FEATURES)
        words = [(m[0], m.start(), m.end()) for m in _WORD.finditer(low)]
        at = [(i, k) for i, (w, _, _) in enumerate(words) if (k := self[w])]
        direct = quoted = fuzzy = stem = dense = address = 0
        for j, (i, kind) in enumerate(at):
            _, a, b = words[i]
            near = [w for w, _, _ in words[max(0, i - WINDOW):i + WINDOW + 1]]
            before = [w for w, _, _ in words[max(0, i - 3):i]]
            cited = (low[a - 1:a] in _QUOTES and a > 0 and low[b:b + 1] in _QUOTES and b < len(low)) \
                or any(w in _REPORT for w in before)
            quoted += cited
            if not cited:
                direct += kind == 1
                fuzzy += kind == 2
                stem += kind == 3
                address += any(w in _ADDRESS for w in near)
                dense += any(abs(at[x][0] - i) <= WINDOW for x in (j - 1, j + 1) if 0 <= x < len(at))
        return np.log1p([direct, quoted, fuzzy, stem, dense, address]).tolist()


class Model:
    """What scoring needs: terms, stems and weights, all bounded."""

    def __init__(self, terms: list[str], stems: list[str], weights: list[float]) -> None:
        self.terms, self.stems, self.weights = terms, stems, weights

    def scorer(self) -> Scorer:
        return only(("scorer", *self.terms, "", *self.stems),
                    lambda: Scorer(self.terms, self.stems))

    def score(self, features: list[float]) -> float:
        z = self.weights[0] + sum(w * x for w, x in zip(self.weights[1:], features))
        return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))


def held_out(doc_id: str = "doc_id") -> F.Column:
    """The fold that is never learned from: crc32 of the id as text, modulo 5, is 0. A null id
    is in no fold and never learned from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> Model:
    """Learn from the labelled documents outside the held-out fold. Labels that are null
    are left out; of several labels of a document the largest counts. Without labelled
    documents of both kinds the model knows no terms and scores every text alike."""
    known = (labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out())
             .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
             .agg(F.max("toxic").cast("int").alias("toxic"))
             .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled))
    # at most max_labelled pairs of numbers
    train = id_text(docs).join(F.broadcast(known), "doc_id").select("doc_id", "toxic", "text")
    # near copies repeat one document's words and one label: they count once, as the one of
    # the least id. Copies agree on the least hashes of their long words by SKETCH functions.
    long_words = F.regexp_extract_all(F.lower("text"), F.lit("[\\p{L}\\p{N}]{5,}"), F.lit(0))
    sketch = F.transform(F.sequence(F.lit(1), F.lit(SKETCH)), lambda i: F.coalesce(
        F.array_min(F.transform(long_words, lambda w: F.xxhash64(w, i))), F.xxhash64("text")))
    terms, stems = _lexicon(train.groupBy("toxic", sketch.alias("_sketch")).agg(
        F.min_by("text", F.struct("doc_id", F.xxhash64("text"))).alias("text")).select("toxic", "text"))
    model = Model(terms, stems, [0.0] * (1 + len(FEATURES)))
    schema = pa.schema([("toxic", pa.int32()), ("x", pa.list_(pa.float64()))])

    def rows(labels: list, texts: list) -> Iterator[tuple]:
        scorer = model.scorer()
        return ((y, scorer.features(t)) for y, t in zip(labels, texts))

    got = train.select("toxic", "text").mapInArrow(map_rows(rows, schema),
                                                   "toxic int, x array<double>").toPandas()
    if len(got):
        # in one order, so that sums don't depend on the partitioning
        found = sorted(zip(got["toxic"].tolist(), map(tuple, got["x"].tolist())))
        model.weights = _logistic(np.array([x for _, x in found]), np.array([float(y) for y, _ in found]))
    return model


def _lexicon(train: DataFrame) -> tuple[list[str], list[str]]:
    schema = pa.schema([("word", pa.string()), ("n1", pa.int64()), ("n0", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n: tuple[dict, dict] = ({}, {})
            for y, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                c = n[y]
                for w in set(_WORD.findall(t.lower())):
                    c[w] = c.get(w, 0) + 1
            # words of clean documents matter only where a toxic one has their beginning
            words = [w for w in n[0].keys() | n[1].keys() if 3 <= len(w) <= 40]
            yield pa.RecordBatch.from_arrays(
                [pa.array(words), pa.array([n[1].get(w, 0) for w in words], pa.int64()),
                 pa.array([n[0].get(w, 0) for w in words], pa.int64())], schema=schema)

    counts = (train.mapInArrow(count, "word string, n1 long, n0 long").groupBy("word")
              .agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0")))
    sure = (counts.filter((F.col("n1") >= MIN_DOCS)
                          & (F.col("n1") >= MIN_SHARE * (F.col("n1") + F.col("n0"))))
            .orderBy(F.desc("n1"), "word").limit(MAX_TERMS))
    terms = [r.word for r in sure.select("word").collect()]
    # beginnings shared by several sure words, the shortest ones first
    below: dict[str, int] = {}
    for t in terms:
        for n in range(STEM[0], min(len(t), STEM[1]) + 1):
            below[t[:n]] = below.get(t[:n], 0) + 1
    wanted = [p for p, n in below.items() if n >= 5]
    stems: list[str] = []
    if wanted:
        # how sure the beginnings are, over all words of the training documents
        spark = train.sparkSession
        beginnings = F.broadcast(spark.createDataFrame([(p,) for p in wanted], "stem string"))
        sums = (counts.select(F.explode(F.transform(
            F.sequence(F.lit(STEM[0]), F.least(F.length("word"), F.lit(STEM[1]))),
            lambda n: F.substring("word", 1, n))).alias("stem"), "n1", "n0")
            .filter(F.length("stem") >= STEM[0]).join(beginnings, "stem")
            .groupBy("stem").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0")).collect())
        good = {r.stem for r in sums if r.n1 >= MIN_SHARE * (r.n1 + r.n0)}
        for p in sorted(good, key=lambda p: (len(p), p)):
            if not any(p.startswith(s) for s in stems):
                stems.append(p)
    return [t for t in terms if not t.startswith(tuple(stems))] if stems else terms, stems


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.01) -> list[float]:
    """Weights (intercept first) by Newton's method."""
    x = np.c_[np.ones(len(x)), x.reshape(len(x), -1)]
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + ridge * w
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), grad)
        w -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return w.tolist()


def score(docs: DataFrame, model: Model,
          names: tuple[str, str] = ("_score", "_predicted")) -> DataFrame:
    """``docs`` and the columns ``names`` (not among its own): the score (0 to 1; null and
    empty texts have one too) and the prediction (1 from 0.5 on)."""
    @F.pandas_udf("double")
    def of(text):
        scorer = model.scorer()
        return text.map(lambda t: model.score(scorer.features(t if isinstance(t, str) else "")))

    small_batches(docs.sparkSession)
    if {n.lower() for n in names} & {c.lower() for c in docs.columns}:
        raise ValueError(f"documents have a column named like one of {names}")
    return (docs.withColumn(names[0], of(F.coalesce(F.col("text"), F.lit(""))))
            .withColumn(names[1], (F.col(names[0]) >= 0.5).cast("int")))
