"""Word-wise memo in front of public tokenizers.

A text is cut where a non-space character is followed by a space or newline.
Every such place is a pre-token boundary of the vocabularies used here whatever
stands before or after, so the pieces can be encoded on their own and a piece
seen before costs one dictionary lookup. Texts in which a cut would fall inside
a run of white space, and texts with a special token's string, are encoded
whole by the library.
"""

from __future__ import annotations

import array
import functools
import json
import re
import string
import unicodedata
from collections.abc import Iterator

import numpy as np

from parkops.llm.common import only

#: White space by Unicode's White_Space property (what both libraries call \\s).
_SPACES = frozenset("\t\n\x0b\x0c\r \x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000"
                    + "".join(map(chr, range(0x2000, 0x200b))))
#: Characters whose class is the same in every Unicode version the libraries use.
_PLAIN = re.compile("[\x00-\u024f]*\\Z")
_MARKS = ".,;:!?|"
#: Entries kept per Python worker (about 200 bytes each), by vocabulary kind. Words met
#: later are encoded once a batch.
MEMO_BYTE_LEVEL, MEMO_WORD_ENDS = 250_000, 700_000


def u32(ids) -> bytes:
    return array.array("I", ids).tobytes()


def _plain_word(w: str) -> bool:
    return w.isalpha() and (w.isascii() or _PLAIN.match(w) is not None)


class _Memo(dict):
    """word -> ids; a word that isn't kept is looked up among the batch's own."""

    def __init__(self, most: int) -> None:
        self.most = most
        self.batch: dict[str, bytes | None] = {}

    def __missing__(self, word: str) -> bytes | None:
        return self.batch[word]

    def add(self, found: dict[str, bytes | None]) -> None:
        self.batch = found
        if len(self) + len(found) <= self.most:
            self.update(found)


class ByteLevel:
    """Byte-level BPE given as a ``tokenizers`` file. ``encode_many`` gives each
    text's ids as little-endian u32 bytes."""

    def __init__(self, path: str) -> None:
        self.path = path
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [a["content"] for a in spec.get("added_tokens", [])]
        self.fast = _by_ranks(spec)
        self.memo = _Memo(MEMO_BYTE_LEVEL)  # of " " + word, or of "\n" and what follows it
        self.mark: dict[str, bytes] = {}
        if self.fast is not None:
            self.newline = self.fast.encode_ordinary("\n")[0]
            n = max(spec["model"]["vocab"].values()) + 1
            self.spaced = np.zeros(n, bool)
            self.spaced[[i for t, i in spec["model"]["vocab"].items() if t[0] == "\u0120"]] = True

    @functools.cached_property
    def tk(self):
        """The library's tokenizer, loaded by the first text that needs it."""
        from tokenizers import Tokenizer
        return Tokenizer.from_file(self.path)

    def library(self, text: str) -> bytes:
        return u32(self.tk.encode(text, add_special_tokens=False).ids)

    def exact(self, text: str) -> bytes:
        """Ids of a whole text, by the library or an equal faster way."""
        if self.fast is None or not _PLAIN.match(text) or any(s in text for s in self.special):
            return self.library(text)
        return u32(self.fast.encode_ordinary(text))

    def _cores(self, words: list[str], sep: str) -> dict[str, bytes]:
        """Letter-only words after a space or newline, encoded in one call."""
        if not words:
            return {}
        ids = np.array(self.fast.encode_ordinary(sep + sep.join(words)), "<u4")
        at = np.flatnonzero(self.spaced[ids] if sep == " " else ids == self.newline)
        if len(at) != len(words):
            return {w: self.exact(sep + w) for w in words}
        raw, cut = ids.tobytes(), [*(at * 4).tolist(), 4 * len(ids)]
        return {w: raw[cut[i]:cut[i + 1]] for i, w in enumerate(words)}

    def _resolve(self, new: list[str]) -> dict[str, bytes | None]:
        out: dict[str, bytes | None] = {}
        composed, cores = [], ({}, {})  # after a space, after a newline
        for w in new:
            if not w or w[-1] in _SPACES:
                out[w] = None
                continue
            line = w[0] == "\n"
            core = w[line:].rstrip(_MARKS)
            if self.fast is None or not _plain_word(core):
                out[w] = self.exact(w if line else " " + w)
            elif (known := self.memo.get("\n" + core if line else core)) is not None:
                out[w] = known + self._mark(w[line + len(core):])
            else:
                cores[line][core] = None
                composed.append((w, line, core))
        known = (self._cores(list(cores[0]), " "), self._cores(list(cores[1]), "\n"))
        for w, line, core in composed:
            out[w] = known[line][core] + self._mark(w[line + len(core):])
        out |= known[0]
        return out

    def _mark(self, marks: str) -> bytes:
        if not marks:
            return b""
        if marks not in self.mark:
            if len(self.mark) > 10_000:
                self.mark.clear()
            self.mark[marks] = self.exact(marks)
        return self.mark[marks]

    def encode_many(self, texts: list[str]) -> list[bytes]:
        cut = [t.replace("\n", " \n").split(" ") for t in texts]
        memo = self.memo
        heads = [parts[0] for parts in cut]
        for parts in cut:
            del parts[0]
        memo.add(self._resolve([w for w in set().union(*cut) if w not in memo]))
        out = []
        for text, head, parts in zip(texts, heads, cut):
            if not text:
                out.append(b"")
                continue
            try:
                if not head or head[-1] in _SPACES or any(s in text for s in self.special):
                    raise TypeError
                out.append(self.exact(head) + b"".join([memo[p] for p in parts]))
            except TypeError:  # a cut would fall inside white space
                out.append(self.exact(text))
        return out


def _by_ranks(spec: dict):
    """The same vocabulary as byte ranks, or None unless merge order is id order
    and the splitting is the plain byte-level one."""
    import public_tokenizers
    import tiktoken
    pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
    if pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) \
            or spec.get("normalizer") or model.get("ignore_merges"):
        return None
    special = {a["content"] for a in spec.get("added_tokens", [])}
    char = _byte_chars()
    ranks = {bytes(char[c] for c in t): i for t, i in model["vocab"].items() if t not in special}
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    order = [model["vocab"][a + b] for a, b in pairs]
    if order != sorted(set(order)):
        return None
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks,
                             special_tokens={})


def _byte_chars() -> dict[str, int]:
    """Byte of each printable stand-in character of byte-level vocabularies:
    printable Latin-1 stands for itself, the other bytes for U+0100 onwards."""
    keep = [*range(0x21, 0x7f), *range(0xa1, 0xad), *range(0xae, 0x100)]
    rest = [b for b in range(256) if b not in set(keep)]
    return {chr(b): b for b in keep} | {chr(256 + i): b for i, b in enumerate(rest)}


#: The splitting and folding that ``WordEnds`` can do itself.
_WORD_SPLIT = {"type": "Sequence", "pretokenizers": [
    {"type": "Split", "behavior": "Removed", "invert": True, "pattern": {
        "Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}
_FOLDED = {"type": "Sequence", "normalizers": [
    {"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "},
    {"type": "Lowercase"}]}


def _plain_split() -> re.Pattern:
    """The pattern of ``_WORD_SPLIT`` over the characters of ``_PLAIN`` in lower case."""
    chars = {"L": "", "N": ""}
    for c in sorted({chr(i).lower() for i in range(0x250) if i != 0x130}):
        kind = unicodedata.category(c)[0]
        if kind in chars:
            chars[kind] += re.escape(c)
    space = "".join(map(re.escape, sorted(_SPACES)))
    return re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{chars['L']}]+|[{chars['N']}]"
                      f"|[^{space}{chars['L']}{chars['N']}]+")


def _word_ranks(spec: dict):
    """The vocabulary for words that end in a-z as byte ranks, such a word's last letter
    written as a capital in place of the word end, and which ids end a word; or None
    unless merge order is id order and text is split and folded as above."""
    import tiktoken
    model = spec["model"]
    if spec.get("pre_tokenizer") != _WORD_SPLIT or spec.get("normalizer") != _FOLDED \
            or spec.get("post_processor") or model.get("end_of_word_suffix") != "</w>" \
            or model.get("type") != "BPE" or model.get("dropout") or model.get("ignore_merges") \
            or model.get("continuing_subword_prefix"):
        return None
    special = {a["content"] for a in spec.get("added_tokens", [])}
    char, vocab = _byte_chars(), model["vocab"]
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    order = [vocab[a.removesuffix("</w>") + b] for a, b in pairs]
    if order != sorted(set(order)) or any(a.endswith("</w>") for a, _ in pairs) \
            or set(vocab.values()) - set(order) - {vocab[t] for t in vocab
                                                   if t in special or len(t.removesuffix("</w>")) == 1}:
        return None
    ranks, ends = {}, np.zeros(max(vocab.values()) + 1, bool)
    for t, i in vocab.items():
        core = t.removesuffix("</w>")
        if t in special or not core or re.search("[A-Z]", core):
            continue
        if core == t:
            ranks[bytes(char[c] for c in t)] = i
        elif "a" <= core[-1] <= "z":
            ranks[bytes(char[c] for c in core[:-1] + core[-1].upper())] = i
            ends[i] = True
    if any(c.encode() not in ranks for c in string.ascii_letters):
        return None
    return tiktoken.Encoding("words", pat_str="[^A-Z]*[A-Z]", mergeable_ranks=ranks,
                             special_tokens={}), ends


class WordEnds:
    """BPE with word ends that drops white space and folds case, given as a
    ``tokenizers`` file."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer
        self.tk = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [a["content"] for a in spec.get("added_tokens", [])]
        self.memo = _Memo(MEMO_WORD_ENDS)
        self.ranks = _word_ranks(spec)
        self.split = _plain_split()

    def library(self, text: str) -> bytes:
        return u32(self.tk.encode(text, add_special_tokens=False).ids)

    def _ranked(self, words: list[str]) -> dict[str, bytes]:
        """Lower-case letter words that end in a-z, several thousand a call."""
        enc, ends = self.ranks
        out: dict[str, bytes] = {}
        for k in range(0, len(words), 4096):
            some = words[k:k + 4096]
            ids = np.array(enc.encode_ordinary("".join([w[:-1] + w[-1].upper() for w in some])), "<u4")
            cut = [0, *(4 * (np.flatnonzero(ends[ids]) + 1)).tolist()]
            raw = ids.tobytes()
            out |= {w: raw[a:z] for w, a, z in zip(some, cut[:-1], cut[1:], strict=True)}
        return out

    def _pretokens(self, new: list[str]) -> dict[str, bytes]:
        """Ids of lower-case pre-tokens of plain texts."""
        ranked, cores, out = [], [], {}
        for w in new:
            if not w.isalpha():
                out[w] = self.library(w)
            elif "a" <= w[-1] <= "z":
                ranked.append(w)
            else:
                cores.append(w)
        return out | self._ranked(ranked) | self._cores(cores)

    def _cores(self, words: list[str]) -> dict[str, bytes]:
        """Letter-only words: each is one pre-token, so one call serves many."""
        out: dict[str, bytes] = {}
        for k in range(0, len(words), 4096):
            some = words[k:k + 4096]
            e = self.tk.encode(" ".join(some), add_special_tokens=False)
            of = np.array(e.word_ids)
            at = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
            if len(at) != len(some):
                out |= {w: self.library(w) for w in some}
                continue
            raw, cut = u32(e.ids), [*(at * 4).tolist(), 4 * len(of)]
            out |= {w: raw[cut[i]:cut[i + 1]] for i, w in enumerate(some)}
        return out

    def _others(self, words: list[str]) -> dict[str, bytes]:
        """Any words, several calls' worth at once: a token belongs to the word it
        starts in."""
        out: dict[str, bytes] = {}
        for k in range(0, len(words), 1024):
            some = words[k:k + 1024]
            e = self.tk.encode(" ".join(some), add_special_tokens=False)
            first = np.cumsum([0, *(len(w) + 1 for w in some)])
            at = np.searchsorted([a for a, _ in e.offsets], first)
            raw = u32(e.ids)
            out |= {w: raw[4 * at[i]:4 * at[i + 1]] for i, w in enumerate(some)}
        return out

    def _resolve(self, new: list[str]) -> dict[str, bytes]:
        out: dict[str, bytes] = {}
        composed, cores, others, memo = [], {}, [], self.memo
        for w in new:
            core = w.rstrip(_MARKS)
            if not _plain_word(core) or "\u0130" in core:
                others.append(w)
                continue
            low, marks = core.lower(), w[len(core):]
            if low not in memo:
                cores[low] = None
            if marks and marks not in memo and marks not in out:
                out[marks] = self.library(marks)
            composed.append((w, low, marks))
        out |= self._cores(list(cores)) | self._others(others)
        memo.batch = out
        return out | {w: memo[low] + (memo[marks] if marks else b"") for w, low, marks in composed}

    def encode_many(self, texts: list[str]) -> list[bytes]:
        if self.ranks is None:
            return self._by_words(texts)
        plain = [_PLAIN.match(t) is not None and "\u0130" not in t
                 and not any(s in t for s in self.special) for t in texts]
        # plain texts are folded and split as the library does it
        cut = [self.split.findall(t.lower()) for t, p in zip(texts, plain) if p]
        memo = self.memo
        memo.add(self._pretokens([w for w in set().union(*cut) if w not in memo]))
        done = iter([b"".join([memo[w] for w in words]) for words in cut])
        others = iter(self._by_words([t for t, p in zip(texts, plain) if not p]))
        return [next(done if p else others) for p in plain]

    def _by_words(self, texts: list[str]) -> list[bytes]:
        # space and newline are white space that the library drops between words
        cut = [t.replace("\n", " ").split(" ") for t in texts]
        memo = self.memo
        memo.add(self._resolve([w for w in set().union(*cut) if w not in memo]))
        return [self.library(t) if any(s in t for s in self.special)
                else b"".join([memo[p] for p in parts]) for t, parts in zip(texts, cut)]


def in_batches(texts: list[str], chars: int = 4_000_000) -> Iterator[slice]:
    """Runs of texts of about so many characters: a word new to the memo is then looked
    up once for many texts."""
    a = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= chars:
            yield slice(a, i + 1)
            a, size = i + 1, 0
    if a < len(texts):
        yield slice(a, len(texts))


def byte_level(path: str) -> ByteLevel:
    return only(("byte_level", path), lambda: ByteLevel(path))


def word_ends(path: str) -> WordEnds:
    return only(("word_ends", path), lambda: WordEnds(path))
