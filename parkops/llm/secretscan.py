"""Secret scans (operator 5): known key shapes, and random strings by token efficiency.

Three fixed shapes are always reported. Beyond them a string of key characters is
reported when the vocabulary of a tiktoken file needs many tokens for it (few
characters a token): words, names and paths compress well, random strings don't.
Strings that merely look random are excluded first: digests (hexadecimal of a known
digest's length), UUIDs, numbers, dates, and identifiers made of words.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parkops.llm.bytebpe import load_ranks
from parkops.llm.common import id_text, map_rows, only, small_batches

KINDS = ("assign", "access", "hex", "random")
#: Characters per token below which a candidate counts as random.
MAX_CHARS_PER_TOKEN = 2.0
MIN_RANDOM = 20

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
                     r"([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII)
_ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}")
_RANDOM = re.compile(rf"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{{{MIN_RANDOM},}}")
_DIGEST = frozenset((32, 40, 56, 64, 96, 128))  # md5, sha1, sha224, sha256, sha384, sha512
_UUID = re.compile(r"[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}\Z")
_HEXONLY = re.compile(r"(?:[0-9a-f]+|[0-9A-F]+)\Z")
#: Words, optionally in capitals or with a number behind, joined by separators.
_IDENTIFIER = re.compile(r"(?:[A-Za-z]?[a-z]+|[A-Z]+|[0-9]+)(?:[-_/+=]+(?:[A-Za-z]?[a-z]+|[A-Z]+|[0-9]+))*"
                         r"[-_/+=]*\Z")


def _tokens(ranks: str, pattern: str):
    def load():
        import tiktoken
        enc = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=load_ranks(ranks),
                                special_tokens={})
        return functools.lru_cache(10_000)(lambda s: len(enc.encode_ordinary(s)))
    return only(("tokens", ranks, pattern), load)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the three fixed shapes, in code points."""
    out = []
    low = text.lower() if text.isascii() else text.casefold()
    if any(w in low for w in _ASSIGN_WORDS):
        out += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text)
                if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)
                if m.end() - m.start() >= 16]
    out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(out)


def looks_random(s: str, n_tokens) -> bool:
    """The token-efficiency test on one candidate."""
    core = s.strip("-_=/+")
    if len(core) < MIN_RANDOM or not any(c.isdigit() for c in core) \
            or not any(c.isalpha() for c in core):
        return False
    if _UUID.match(core) or _HEXONLY.match(core) and len(core) in _DIGEST \
            or _IDENTIFIER.match(core):
        return False
    return len(core) / n_tokens(core) < MAX_CHARS_PER_TOKEN


def spans(text: str, n_tokens) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(base, all) spans; random ones overlap no base span."""
    base = base_spans(text)
    more = [(m.start(), 3, m.end()) for m in _RANDOM.finditer(text)
            if not any(a < m.end() and m.start() < b for a, _, b in base)
            and looks_random(m[0], n_tokens)]
    return base, sorted(base + more)


def _joined(found: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in found)


def scan(docs: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """Per document: doc_id, n_assign, n_access, n_hex, n_random, base_sha256, spans.

    Spans are in code points, end exclusive, by start and then kind. Null and empty
    texts have none (base_sha256 is that of the empty string)."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_assign", pa.int64()), ("n_access", pa.int64()),
                        ("n_hex", pa.int64()), ("n_random", pa.int64()),
                        ("base_sha256", pa.string()), ("spans", pa.string())])

    def rows(ids: list, texts: list) -> Iterator[tuple]:
        n_tokens = _tokens(ranks, pattern)
        for i, t in zip(ids, texts):
            base, every = spans(t, n_tokens)
            n = [sum(k == x for _, k, _ in every) for x in range(4)]
            yield (i, *n, hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(every))

    return id_text(docs).mapInArrow(
        map_rows(rows, schema), "doc_id long, n_assign long, n_access long, n_hex long, "
        "n_random long, base_sha256 string, spans string")


def redact(docs: DataFrame, ranks: str, pattern: str, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span replaced by ``mark`` and ``n_chars`` (if there) of the
    new text; other columns and texts without spans stay as they are."""
    @F.pandas_udf("string")
    def clean(text):
        n_tokens = _tokens(ranks, pattern)

        def one(t):
            if not t:
                return t
            found = spans(t, n_tokens)[1]
            if not found:
                return t
            out, at = [], 0
            for a, _, b in found:
                if a >= at:
                    out += [t[at:a], mark]
                at = max(at, b)
            return "".join(out) + t[at:]
        return text.map(one)

    small_batches(docs.sparkSession)
    out = docs.withColumn("text", clean(F.col("text")))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns \
        else out
