"""Byte-pair encoding by speculation, and decoding.

A word is first cut greedily into the longest tokens. A cut is the one that merging gives if every token merges to
itself and no two neighbours would have merged across their border; the borders of all new words of a batch are
tested together on arrays. Only words with a failing border are merged step by step.

Ids are one binary column, each id a little-endian unsigned 32-bit integer.
"""

from __future__ import annotations

import hashlib
import heapq
import itertools
import json
from array import array
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm.common import own_name, ship, text_of

# The word pattern of byte-level vocabularies (fixed value); white space is the Unicode property.
WORD_PATTERN = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
    r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)
# Words up to this many code points are remembered, up to this many bytes; longer ones are encoded each time.
REMEMBER_CHARS = 64
REMEMBER_BYTES = 32_000_000
# What a remembered word takes beside its own letters and ids (fixed value: two objects and a place in a table).
_WORD_BYTES = 200
# Texts are encoded together up to this many code points.
BATCH_CHARS = 300_000

# Words up to this many bytes are merged by scanning their ranks, longer ones with a heap.
SCAN_BYTES = 64

_NEVER = np.int64(1 << 40)
_NO_RANK = 1 << 40
_GAP = chr(256)


def _byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in a byte-level vocabulary, as letter -> byte."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Pieces:
    """The bytes of each token of one vocabulary file: all that decoding needs."""

    def __init__(self, spec: dict):
        letters = _byte_letters()
        vocab: dict[str, int] = spec["model"]["vocab"]
        added = {a["content"]: a["id"] for a in spec.get("added_tokens") or []}
        size = max([*vocab.values(), *added.values()], default=-1) + 1
        self.bytes: list[bytes] = [b""] * size
        for token, i in vocab.items():
            self.bytes[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        for token, i in added.items():
            self.bytes[i] = token.encode()
        self.size = size

    def decode(self, ids: bytes) -> str:
        """The text of packed ids; ids outside the vocabulary are left out, broken UTF-8 becomes U+FFFD."""
        at = np.frombuffer(ids, dtype="<u4")
        if len(at) and int(at.max()) >= self.size:
            at = at[at < self.size]
        return b"".join(map(self.bytes.__getitem__, at.tolist())).decode("utf-8", "replace")

class Merges(Pieces):
    """The tables of one vocabulary file: token bytes, merges by rank, and the tests on borders."""

    def __init__(self, spec: dict):
        super().__init__(spec)
        size, letters = self.size, _byte_letters()
        vocab: dict[str, int] = spec["model"]["vocab"]
        added = {a["content"]: a["id"] for a in spec.get("added_tokens") or []}
        self.added = {k: array("I", [v]).tobytes() for k, v in added.items()}
        self.byte_id = [vocab.get(c) for c, _ in sorted(letters.items(), key=lambda x: x[1])]
        parts = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        left = np.array([vocab[a] for a, _ in parts], dtype=np.int64)
        right = np.array([vocab[b] for _, b in parts], dtype=np.int64)
        made = np.array([vocab[a + b] for a, b in parts], dtype=np.int64)
        keys = left * size + right
        self._order = np.argsort(keys, kind="stable")
        self._keys = keys[self._order]
        self.rank, self.made = {k: r for r, k in enumerate(keys.tolist())}, made.tolist()
        # Rank at which a token is made, and its two halves; single bytes are there from the start.
        self.born = np.full(size, -1, dtype=np.int64)
        self.first, self.last = np.zeros(size, dtype=np.int64), np.zeros(size, dtype=np.int64)
        self.born[made[::-1]] = np.arange(len(made))[::-1]
        self.first[made[::-1]], self.last[made[::-1]] = left[::-1], right[::-1]
        whole = self._whole()
        self.automaton = ahocorasick.Automaton()
        for i in np.flatnonzero(whole).tolist():
            self.automaton.add_word(self.bytes[i].decode("latin-1"), i)
        self.automaton.make_automaton()
        specials = sorted(added, key=len, reverse=True)
        self.specials = regex.compile("(" + "|".join(regex.escape(x) for x in specials) + ")") if specials else None
        self.words = regex.compile(WORD_PATTERN)
        self.known: dict[str, bytes] = {}
        self.known_bytes = 0

    def rank_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of merging a with b; beyond all ranks where they never merge."""
        if not len(self._keys):
            return np.full(len(a), _NEVER)
        keys = a * self.size + b
        at = np.minimum(np.searchsorted(self._keys, keys), len(self._keys) - 1)
        return np.where(self._keys[at] == keys, self._order[at], _NEVER)

    def apart(self, a: np.ndarray, b: np.ndarray, before: np.ndarray | None = None) -> np.ndarray:
        """Whether merging bytes(a) + bytes(b) never crosses the border (before the given rank).

        Time runs backwards: the later made of the two tokens at the border is taken apart, and the pair left at
        the border must not merge earlier than that token was made. Of equal ranks the left merge comes first.
        """
        x, y = a.astype(np.int64).copy(), b.astype(np.int64).copy()
        end = np.full(len(x), _NEVER) if before is None else before.astype(np.int64).copy()
        fine, live = np.ones(len(x), dtype=bool), np.arange(len(x))
        while live.size:
            crossing = self.rank_of(x[live], y[live]) < end[live]
            fine[live[crossing]] = False
            live = live[~crossing]
            bx, by = self.born[x[live]], self.born[y[live]]
            right = (by >= bx) & (by >= 0)
            left = ~right & (bx >= 0)
            r, li = live[right], live[left]
            end[r], y[r] = by[right] + 1, self.first[y[r]]
            end[li], x[li] = bx[left], self.last[x[li]]
            live = live[right | left]
        return fine

    def _whole(self) -> np.ndarray:
        """Which tokens merge to themselves from their bytes."""
        whole = np.zeros(self.size, dtype=bool)
        whole[[i for i in self.byte_id if i is not None]] = True
        made = np.flatnonzero(self.born >= 0)
        made = made[np.argsort(self.born[made])]
        alone = self.apart(self.first[made], self.last[made], self.born[made])
        for i, fine in zip(made.tolist(), alone.tolist(), strict=True):
            whole[i] = fine and whole[self.first[i]] and whole[self.last[i]]
        return whole

    def longest(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All words cut greedily into the longest tokens that merge to themselves: tokens, and the word of each."""
        # Bytes become letters of the same number; the letter after the last byte parts the words.
        line = _GAP.join(w.decode("latin-1") for w in words)
        cuts = np.fromiter((x for cut in self.automaton.iter_long(line) for x in cut), dtype=np.int64).reshape(-1, 2)
        ends = np.cumsum([len(w) + 1 for w in words])
        return cuts[:, 1], np.searchsorted(ends, cuts[:, 0], side="right")

    def merged(self, word: bytes) -> list[int]:
        """The word merged step by step: lowest rank first, leftmost of equals."""
        ids = [t for b in word if (t := self.byte_id[b]) is not None]
        if len(ids) > SCAN_BYTES:
            return self._merged_long(ids)
        size, rank, made = self.size, self.rank.get, self.made
        ranks = [rank(a * size + b, _NO_RANK) for a, b in itertools.pairwise(ids)]
        while ranks and (lowest := min(ranks)) < _NO_RANK:
            i = ranks.index(lowest)
            ids[i:i + 2] = [made[lowest]]
            del ranks[i]
            if i:
                ranks[i - 1] = rank(ids[i - 1] * size + ids[i], _NO_RANK)
            if i < len(ranks):
                ranks[i] = rank(ids[i] * size + ids[i + 1], _NO_RANK)
        return ids

    def _merged_long(self, ids: list[int | None]) -> list[int]:
        """The same with a heap of candidates, so that a word without breaks costs n log n."""
        n, size, rank, made = len(ids), self.size, self.rank.get, self.made
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i) for i in range(n - 1) if (r := rank(ids[i] * size + ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            lowest, i = heapq.heappop(heap)
            j = after[i] if ids[i] is not None else n
            if j >= n or rank(ids[i] * size + ids[j]) != lowest:
                continue
            ids[i], ids[j] = made[lowest], None
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for k, m in ((before[i], i), (i, after[i])):
                if k >= 0 and m < n and (r := rank(ids[k] * size + ids[m])) is not None:
                    heapq.heappush(heap, (r, k))
        return [i for i in ids if i is not None]

    def cut(self, words: list[str]) -> dict[str, bytes]:
        """The packed ids of each word."""
        raw = [w.encode() for w in words]
        flat, word = self.longest(raw)
        inner = word[1:] == word[:-1]
        a, b, of = flat[:-1][inner], flat[1:][inner], word[1:][inner]
        pairs, place = np.unique(a * self.size + b, return_inverse=True)
        fine = self.apart(pairs // self.size, pairs % self.size) if len(pairs) else np.ones(0, dtype=bool)
        packed, ends = flat.astype("<u4").tobytes(), np.searchsorted(word, np.arange(len(words) + 1)) * 4
        ends = ends.tolist()
        cuts = {w: packed[ends[i]:ends[i + 1]] for i, w in enumerate(words)}
        for i in np.unique(of[~fine[place]]).tolist():
            cuts[words[i]] = array("I", self.merged(raw[i])).tobytes()
        return cuts

    def encode(self, texts: list[str]) -> list[bytes]:
        """The packed ids of each text; strings of added tokens stand for those tokens."""
        pieces = []
        for text in texts:
            parts = self.specials.split(text) if self.specials else [text]
            pieces.append([p if i % 2 else self.words.findall(p) for i, p in enumerate(parts)])
        new = set().union(*(p for parts in pieces for p in parts[::2])) - self.known.keys()
        if self.known_bytes > REMEMBER_BYTES:
            self.known.clear()
            self.known_bytes = 0
            new = set().union(*(p for parts in pieces for p in parts[::2]))
        if new:
            cuts = self.cut(list(new))
            self.known.update(cuts)
            self.known_bytes += sum(len(w) + len(x) + _WORD_BYTES for w, x in cuts.items())
        cut = self.known.__getitem__
        out = [b"".join(self.added[p] if i % 2 else b"".join(map(cut, p)) for i, p in enumerate(parts))
               for parts in pieces]
        for word in [w for w in new if len(w) > REMEMBER_CHARS]:
            self.known_bytes -= len(word) + len(self.known.pop(word)) + _WORD_BYTES
        return out


_loaded: dict[tuple[type, int], Pieces] = {}


def _tables(kind: type, raw: bytes):
    """The tables of a kind, made once per Python worker and vocabulary."""
    key = kind, hash(raw)
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = kind(json.loads(raw))
    return _loaded[key]


def _groups(texts: list[str]) -> Iterator[list[str]]:
    group, chars = [], 0
    for text in texts:
        group.append(text)
        chars += len(text)
        if chars >= BATCH_CHARS:
            yield group
            group, chars = [], 0
    if group:
        yield group


class Tokenizer:
    """Encoding and decoding columns with the vocabulary of one file.

    The file (a few MB, the size of a vocabulary) is read by the driver and broadcast.
    """

    def __init__(self, spark: SparkSession, vocabulary: str):
        ship(spark)
        with open(vocabulary, "rb") as file:
            self._raw = spark.sparkContext.broadcast(file.read())

    def ids(self, text: Column) -> Column:
        """Packed ids of a text; NULL is encoded as the empty text, which has no ids."""
        raw = self._raw

        @F.pandas_udf("binary")
        def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            merges = _tables(Merges, raw.value)
            for batch in batches:
                yield pd.Series([x for g in _groups(batch.tolist()) for x in merges.encode(g)], dtype=object)

        return encode(F.coalesce(text, F.lit("")))

    def round_trip(self, text: Column) -> Column:
        """Packed ids of a text, and the SHA-256 of the text decoded from them, both from one Python worker.

        Two functions in one plan would be two workers a core, each with the tables of the vocabulary.
        """
        raw = self._raw

        @F.pandas_udf("ids binary, decoded_sha256 string")
        def both(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            merges = _tables(Merges, raw.value)
            for batch in batches:
                ids, digests = [], []
                for group in _groups(batch.tolist()):
                    for x in merges.encode(group):
                        ids.append(x)
                        digests.append(hashlib.sha256(merges.decode(x).encode()).hexdigest())
                yield pd.DataFrame({"ids": ids, "decoded_sha256": digests}, dtype=object)

        return both(F.coalesce(text, F.lit("")))

    def text(self, ids: Column) -> Column:
        """The text of packed ids; NULL is decoded as no ids."""
        raw = self._raw

        @F.pandas_udf("string")
        def decode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            pieces = _tables(Pieces, raw.value)
            for batch in batches:
                yield pd.Series([pieces.decode(x) for x in batch], dtype=object)

        return decode(F.coalesce(ids, F.lit(b"")))


def encode(df: DataFrame, vocabulary: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``df`` with a column ``ids``: the packed ids of the whole text.

    NULL and empty texts have no ids (an empty binary). Rows are kept one by one, so repeated rows and an empty table
    need no rule. A column of the name ``ids`` is replaced; all others pass untouched.
    """
    return df.withColumn(ids, Tokenizer(df.sparkSession, vocabulary).ids(F.col(f"`{text}`")))


def decode(df: DataFrame, vocabulary: str, ids: str = "ids", text: str = "text") -> DataFrame:
    """``df`` with a column ``text``: what the packed ids stand for; NULL and empty ids give the empty text."""
    return df.withColumn(text, Tokenizer(df.sparkSession, vocabulary).text(F.col(f"`{ids}`")))


def digests(docs: DataFrame, vocabulary: str) -> DataFrame:
    """Per document: number of ids, and SHA-256 of its packed ids and of the text decoded from them."""
    done = own_name(docs, "done")
    both = docs.select("doc_id", Tokenizer(docs.sparkSession, vocabulary).round_trip(text_of("text")).alias(done))
    return both.select(
        "doc_id",
        (F.octet_length(f"{done}.ids") / 4).cast("long").alias("n_tokens"),
        F.sha2(f"{done}.ids", 256).alias("ids_sha256"),
        F.col(f"{done}.decoded_sha256").alias("decoded_sha256"),
    )
