"""Chat formatting: recover who speaks, then render turns canonically (operator 9).

A hidden Markov model: the states are the roles, and a turn is observed through its
speaker marker ("User:", "### Assistant", ...) and its line features (length, lines,
question, place at the start). Probabilities are counts over all turns whose role is
known. Viterbi finds the likeliest roles; the given role is never an input of it.

A conversation of any length is cut into segments of at most ``SEGMENT`` rows. Viterbi is
a product of (max, +) matrices, which is associative: segments give one small matrix each
in parallel, these tell at which roles each segment begins and ends, and segments are
then traced back in parallel.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parkops.llm.common import NULL_ID, to_batch, written

ROLES = ("system", "user", "assistant")
SEGMENT = 1024
FEATURES = ("marker", "length", "lines", "asks", "place")

#: Speaker markers at the start of a turn, by role.
_MARKERS = {"system": "system|instructions?|context", "user": "user|human|question|q|you|customer",
            "assistant": "assistant|ai|bot|model|answer|a|agent|gpt"}
_MARK = re.compile(r"\s*(?:#{1,4}\s*|\*\*|<\|?|\[)?(?:" + "|".join(
    f"(?P<{r}>{w})" for r, w in _MARKERS.items())
    + r")(?:\*\*\s*[:>]|\s*[:>]\*\*|\|?>|\]\s*:?|\s*:)[ \t]*\n?", re.IGNORECASE)


def marker(text: str) -> tuple[str, int]:
    """(role named by a marker at the start, where the text goes on)."""
    m = _MARK.match(text)
    return (m.lastgroup, m.end()) if m else ("", 0)


def observe(turn: int, text: str) -> tuple[str, ...]:
    """The turn's features, each as a short value."""
    role, at = marker(text)
    body = text[at:].strip()
    return (role, str(min(len(body).bit_length(), 14)), str(min(body.count("\n"), 4)),
            str(int(body.endswith("?"))), str(min(turn, 2) if turn >= 0 else 0))


def render(role: str, text: str) -> str:
    """The canonical turn."""
    return f"<|{role}|>\n{text[marker(text)[1]:].strip()}\n<|end|>\n"


class Model:
    """Log probabilities: of roles after a role (or at the start), of features by role."""

    def __init__(self, follows: dict, shows: dict) -> None:
        n = len(ROLES)
        self.next = [[0.0] * n for _ in range(n + 1)]
        for i, a in enumerate((*ROLES, "")):
            all_ = sum(follows.get((a, b), 0) for b in ROLES) + n
            self.next[i] = [math.log((follows.get((a, b), 0) + 1) / all_) for b in ROLES]
        self.shows = shows
        self.sums = {(f, r): sum(c for (g, s, _), c in shows.items() if (g, s) == (f, r))
                     for f in FEATURES for r in ROLES}

    def emit(self, seen: tuple[str, ...]) -> list[float]:
        return [sum(math.log((self.shows.get((f, r, v), 0) + 0.5) / (self.sums[f, r] + 8))
                    for f, v in zip(FEATURES, seen)) for r in ROLES]

    def step(self, score: list[float], seen: list[float]) -> tuple[list[float], list[int]]:
        """One turn further: the best score of each role and the role before it."""
        back = [max(range(len(ROLES)), key=lambda i: score[i] + self.next[i][j])
                for j in range(len(ROLES))]
        return [score[i] + self.next[i][j] + seen[j] for j, i in enumerate(back)], back

    def enter(self, before: int, seen: list[float]) -> list[float]:
        """Scores of a segment's first turn after the role ``before`` (3: the start)."""
        return [a + b for a, b in zip(self.next[before], seen)]


def _prepared(turns: DataFrame) -> DataFrame:
    turn = F.coalesce(F.col("turn").cast("long"), F.lit(NULL_ID))
    text = F.coalesce(F.col("text"), F.lit(""))
    return turns.select(
        F.coalesce(F.col("conv_id").cast("long"), F.lit(NULL_ID)).alias("conv"), turn.alias("turn"),
        text.alias("text"),
        F.xxhash64(text).alias("tie"), F.lower(F.trim("role")).alias("role"))


def _segmented(rows: DataFrame) -> DataFrame:
    """With ``place`` (ascending in the order of turns) and ``segment``: at most ``SEGMENT``
    rows that follow each other. A range sort deals one conversation, one turn number and
    even equal rows to many tasks, which number their own rows."""
    rows = (rows.withColumn("equal", F.monotonically_increasing_id())
            .orderBy("conv", "turn", "tie", "equal").drop("equal")
            .withColumn("place", F.monotonically_increasing_id()))
    part = F.shiftright("place", 33)
    return written(rows.withColumn("segment", F.shiftleft(part, 33) + F.floor(
        (F.col("place") - F.shiftleft(part, 33)) / SEGMENT)), "turns")


def fit(turns: DataFrame) -> Model:
    """Count over all turns with a known role. Few numbers reach the driver: one per
    pair of roles and per role and feature value."""
    rows = _prepared(turns)
    known = rows.filter(F.col("role").isin(*ROLES))
    schema = pa.schema([("role", pa.string()), ("feature", pa.string()), ("value", pa.string()),
                        ("n", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n: dict[tuple, int] = {}
            for turn, role, text in zip(*(c.to_pylist() for c in b.columns)):
                for f, v in zip(FEATURES, observe(turn, text)):
                    n[role, f, v] = n.get((role, f, v), 0) + 1
            yield to_batch([(*k, c) for k, c in n.items()], schema)

    shows = {(r.feature, r.role, r.value): r.n for r in known.select("turn", "role", "text")
             .mapInArrow(count, "role string, feature string, value string, n long")
             .groupBy("role", "feature", "value").agg(F.sum("n").alias("n")).collect()}
    # the turn before, by its number: keys hold few rows, whatever a conversation's length
    one = known.select("conv", "turn", "role").dropDuplicates(["conv", "turn"])
    before = one.filter(F.col("turn") < NULL_ID).select("conv", (F.col("turn") + 1).alias("turn"), F.col("role").alias("before"))
    follows = {(r.before, r.role): r.n for r in one.join(before, ["conv", "turn"], "left")
               .filter((F.col("turn") == 0) | F.col("before").isNotNull())
               .groupBy(F.coalesce("before", F.lit("")).alias("before"), "role")
               .agg(F.count("*").alias("n")).collect()}
    return Model(follows, shows)


def format_chats(turns: DataFrame, model: Model) -> DataFrame:
    """Per turn: conv_id, turn, role (recovered), rendered.

    Turns are taken by number, ties by a hash of their text; a null turn comes last, and
    turns without a conv_id are one conversation. Null and empty texts are turns with an
    empty body. Repeated rows stay."""
    rows = _segmented(_prepared(turns).select("conv", "turn", "tie", "text")).drop("tie")
    order = ["conv", "segment", "place"]
    states = range(len(ROLES))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("conv", pa.int64()), ("segment", pa.int64()),
                            ("scores", pa.list_(pa.float64()))])
        key, scores, out = None, None, []
        for b in batches:
            for conv, segment, turn, text in zip(*(c.to_pylist() for c in b.columns)):
                seen = model.emit(observe(turn, text))
                if (conv, segment) != key:
                    if key:
                        out.append((*key, sum(scores, [])))
                    key, scores = (conv, segment), [model.enter(i, seen) for i in range(4)]
                else:
                    scores = [model.step(s, seen)[0] for s in scores]
            if len(out) > 1000:
                yield to_batch(out, schema)
                out = []
        if key:
            out.append((*key, sum(scores, [])))
        if out:
            yield to_batch(out, schema)

    def connect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("conv", pa.int64()), ("segment", pa.int64()), ("first", pa.int32()),
                            ("last", pa.int32())])

        def solve(conv: int, parts: list) -> Iterator[tuple]:
            best = [parts[0][1][9:]]  # from the start
            came = []
            for _, m in parts[1:]:
                back = [max(states, key=lambda i: best[-1][i] + m[3 * i + j]) for j in states]
                came.append(back)
                best.append([best[-1][i] + m[3 * i + j] for j, i in enumerate(back)])
            at = max(states, key=lambda j: best[-1][j])
            ends = []
            for k in range(len(parts) - 1, -1, -1):
                before = came[k - 1][at] if k else 3
                ends.append((conv, parts[k][0], before, at))
                at = before
            return reversed(ends)

        conv, parts = None, []
        for b in batches:
            out = []
            for c, segment, m in zip(*(x.to_pylist() for x in b.columns)):
                if c != conv and parts:
                    out += solve(conv, parts)
                    parts = []
                conv = c
                parts.append((segment, m))
            if out:
                yield to_batch(out, schema)
        if parts:
            yield to_batch(list(solve(conv, parts)), schema)

    def trace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()),
                            ("rendered", pa.string())])

        def solve(held: list) -> pa.RecordBatch:
            before, last = held[0][4:]
            seen = [model.emit(observe(t, x)) for _, _, t, x, _, _ in held]
            score, came = model.enter(before, seen[0]), []
            for s in seen[1:]:
                score, back = model.step(score, s)
                came.append(back)
            roles = [last]
            for back in reversed(came):
                roles.append(back[roles[-1]])
            return to_batch([(None if c == NULL_ID else c, None if t == NULL_ID else t, ROLES[r],
                              render(ROLES[r], x))
                             for (c, _, t, x, _, _), r in zip(held, reversed(roles))], schema)

        held: list = []
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns)):
                if held and row[:2] != held[-1][:2]:
                    yield solve(held)
                    held = []
                held.append(row)
        if held:
            yield solve(held)

    measured = (rows.repartition("conv", "segment").sortWithinPartitions(*order)
                .select("conv", "segment", "turn", "text")
                .mapInArrow(measure, "conv long, segment long, scores array<double>"))
    ends = (written(measured, "segments").repartition("conv")
            .sortWithinPartitions("conv", "segment")
            .mapInArrow(connect, "conv long, segment long, first int, last int"))
    return (rows.join(ends, ["conv", "segment"]).repartition("conv", "segment")
            .sortWithinPartitions(*order).select("conv", "segment", "turn", "text", "first", "last")
            .mapInArrow(trace, "conv_id long, turn long, role string, rendered string"))
