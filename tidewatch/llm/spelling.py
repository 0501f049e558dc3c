"""Spelling variants: words one edit apart, found in k-d trees over their letter counts.

One inserted, deleted or replaced letter changes letter counts by one up, one down, or one of each: an L1 distance of
two at most. Words of one length lie in a tree whose inner nodes split on the count of one letter. A word descends it
with one count to raise and one to lower, and skips every box it can't reach so; words of the next length are searched
with one count to raise. What is met is checked for the order of its letters.

The upper part of each tree is fitted to a bounded sample and cuts the words into leaves of bounded size. Each leaf is
one group of a shuffle, with the words that reach it, and has a tree of its own.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import own_name, ship, stored, text_of

# Letters of a run, upper case that is folded, shortest word, fewest occurrences, how much more frequent a form is.
RUN = "[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LEAST_CHARS, LEAST_COUNT, FORM_TIMES = 7, 2, 10
# The upper trees are fitted to about so many words, by a hash. Leaves aim at so many words and bytes.
FIT_WORDS = 50_000
LEAF_WORDS, LEAF_BYTES = 8_192, 4_000_000
# Within a leaf: words in a box of the lowest level, and queries or bytes compared with them at once.
BOX, SLICE, SLICE_BYTES = 16, 4_096, 16_000_000
# Letter counts from this on look alike when boxes are compared; letter order decides then.
LEVELS = 6

# The place of each letter of a word (one byte, Latin-1) in a vector of counts.
_ALPHABET = np.array([*range(ord("a"), ord("z") + 1), *range(0xC0, 0x100)])
_PLACE = np.full(256, -1)
_PLACE[_ALPHABET] = np.arange(len(_ALPHABET))


def letters_of(words: list[bytes] | bytes, length: int) -> np.ndarray:
    """Words of one length as a matrix, one row a word and one byte a letter."""
    return np.frombuffer(words if isinstance(words, bytes) else b"".join(words), dtype=np.uint8).reshape(-1, length)


def counts_of(letters: np.ndarray) -> np.ndarray:
    """How often each word has each letter."""
    rows, size = letters.shape[0], len(_ALPHABET)
    at = np.arange(rows)[:, None] * size + _PLACE[letters]
    return np.bincount(at.ravel(), minlength=rows * size).reshape(rows, size).astype(np.int32)


class Tree(NamedTuple):
    """Nodes: the letter split on (-1 in a leaf), the largest count on the left, the two children; the leaf's number."""

    letter: np.ndarray
    most: np.ndarray
    left: np.ndarray
    right: np.ndarray
    leaf: np.ndarray


ONE_LEAF = Tree(*(np.array([x]) for x in (-1, 0, 0, 0, 0)))


def _split(counts: np.ndarray) -> tuple[int, int] | None:
    """The letter and count that part the rows most evenly; None where all rows are equal."""
    values = np.unique(counts)[:-1]
    for tried in (values[:LEVELS], values[LEVELS:]):
        if len(tried):
            share = np.stack([(counts <= v).mean(axis=0) for v in tried])
            best = np.unravel_index(np.argmin(np.abs(share - 0.5)), share.shape)
            if 0 < share[best] < 1:
                return int(best[1]), int(tried[best[0]])
    return None


def tree(counts: np.ndarray, size: int) -> Tree:
    """The tree of these rows, split until ``size`` or equal ones are left in a box."""
    nodes: list[list[int]] = [[-1, 0, 0, 0, 0]]
    todo, leaves = [(0, np.arange(len(counts)))], 0
    while todo:
        node, rows = todo.pop()
        cut = _split(counts[rows]) if len(rows) > size else None
        if cut is None:
            nodes[node] = [-1, 0, 0, 0, leaves]
            leaves += 1
            continue
        below = counts[rows, cut[0]] <= cut[1]
        nodes[node] = [*cut, len(nodes), len(nodes) + 1, -1]
        todo += [(len(nodes), rows[below]), (len(nodes) + 1, rows[~below])]
        nodes += [[], []]
    return Tree(*(np.array(x) for x in zip(*nodes, strict=True)))


def reached(t: Tree, counts: np.ndarray, more: int, fewer: int) -> Iterator[tuple[int, np.ndarray]]:
    """Per leaf the rows that reach its box when up to ``more`` counts are raised and ``fewer`` lowered by one (0 or 1)."""
    free, spent = -1, -2
    rows = np.arange(len(counts))
    todo = [(0, rows, np.full(len(rows), free if more else spent), np.full(len(rows), free if fewer else spent))]
    while todo:
        node, rows, up, down = todo.pop()
        if not len(rows):
            continue
        letter, most = t.letter[node], t.most[node]
        if letter < 0:
            yield int(t.leaf[node]), rows
            continue
        value = counts[rows, letter] + (up == letter) - (down == letter)
        below = value <= most
        rise = (value == most) & (up == free) & (down != letter)
        fall = (value == most + 1) & (down == free) & (up != letter)
        for child, own, moved, falls in ((t.left[node], below, fall, True), (t.right[node], ~below, rise, False)):
            at = own | moved
            to_up, to_down = up[at], down[at]
            (to_down if falls else to_up)[moved[at]] = letter
            todo.append((int(child), rows[at], to_up, to_down))


def leaf_words(length: int) -> int:
    return max(64, min(LEAF_WORDS, LEAF_BYTES // length))


class Forest(NamedTuple):
    """The upper tree of each length that needs one, and in how many parts each crowded leaf is cut."""

    trees: dict[int, Tree]
    parts: dict[tuple[int, int], int]

    def tree(self, length: int) -> Tree:
        return self.trees.get(length, ONE_LEAF)

    def placed(self, length: int, letters: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The leaf and part of each word."""
        leaf, part = np.zeros(len(counts), dtype=np.int64), np.zeros(len(counts), dtype=np.int64)
        for number, rows in reached(self.tree(length), counts, 0, 0):
            leaf[rows] = number
            parts = self.parts.get((length, number), 1)
            if parts > 1:
                part[rows] = [xxhash.xxh3_64_intdigest(letters[r].tobytes()) % parts for r in rows.tolist()]
        return leaf, part


def _by_length(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """The words of a batch by length, as letters and numbers of occurrences."""
    groups = defaultdict(lambda: ([], []))
    for word, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
        raw = word.encode("latin-1")
        words, counts = groups[len(raw)]
        words.append(raw)
        counts.append(n)
    for length, (words, counts) in groups.items():
        yield length, letters_of(words, length), np.array(counts, dtype=np.int64)


# A word in its own leaf, one of the same length that reaches the leaf, one that is a letter shorter.
MEMBER, EQUAL, SHORTER = 0, 1, 2
_ROUTED = pa.schema([("length", pa.int64()), ("leaf", pa.int64()), ("part", pa.int64()), ("role", pa.int64()),
                     ("words", pa.binary()), ("counts", pa.binary())])
_ROUTED_SQL = "length long, leaf long, part long, role long, words binary, counts binary"


def routed(forest: Forest, length: int, letters: np.ndarray, n: np.ndarray) -> Iterator[tuple]:
    """To which leaves words of one length go, and as what; a pair of leaves is met in the later one only."""
    counts = counts_of(letters)

    def row(to: int, leaf: int, part: int, role: int, at) -> tuple:
        return to, leaf, part, role, letters[at].tobytes(), n[at].tobytes()

    leaf, part = forest.placed(length, letters, counts)
    own = leaf << 32 | part
    for key in np.unique(own).tolist():
        yield row(length, key >> 32, key & 0xFFFFFFFF, MEMBER, own == key)
    for role, to, more, fewer in ((EQUAL, length, 1, 1), (SHORTER, length + 1, 1, 0)):
        for number, rows in reached(forest.tree(to), counts, more, fewer):
            for p in range(forest.parts.get((to, number), 1)):
                at = rows[own[rows] < (number << 32 | p)] if role == EQUAL else rows
                if len(at):
                    yield row(to, number, p, role, at)


def _boxes(counts: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Counts as bits, one for each letter and level: as many bits differ as counts do."""
    bits = np.concatenate([counts[:, most >= level] >= level for level in range(1, LEVELS + 1)], axis=1)
    packed = np.packbits(bits, axis=1)
    return np.ascontiguousarray(np.pad(packed, ((0, 0), (0, -packed.shape[1] % 8)))).view(np.uint64)


def one_replaced(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a != b).sum(axis=1) == 1


def one_inserted(short: np.ndarray, long: np.ndarray) -> np.ndarray:
    """Whether taking one letter out of the long word gives the short one: equal starts and equal ends cover it."""
    start = np.cumprod(short == long[:, :-1], axis=1, dtype=np.uint8).sum(axis=1, dtype=np.int64)
    end = np.cumprod((short == long[:, 1:])[:, ::-1], axis=1, dtype=np.uint8).sum(axis=1, dtype=np.int64)
    return start + end >= short.shape[1]


def near_pairs(members: np.ndarray, others: np.ndarray, within: bool) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of members and others that are one edit apart; others have the same length or a letter less.

    With ``within`` the others are the members themselves, and each pair is met once.
    """
    same = members.shape[1] == others.shape[1]
    counts, asked = counts_of(members), counts_of(others)
    most = np.maximum(counts.max(axis=0), asked.max(axis=0))
    apart = 2 if same else 1
    least = apart if most.max() <= LEVELS else 0
    boxes, probes = _boxes(counts, most), _boxes(asked, most)
    local = tree(counts, BOX)
    inside = dict(reached(local, counts, 0, 0))
    found_members, found_others = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
    verified = max(1, SLICE_BYTES // (4 * members.shape[1]))
    for leaf, rows in reached(local, asked, 1, int(same)):
        own = inside.get(leaf)
        if own is None:
            continue
        # Equal vectors can fill a box beyond its size: boxes are compared in slices.
        for first in range(0, len(own), SLICE):
            points = own[first:first + SLICE]
            step = max(1, SLICE * BOX // len(points))
            for start in range(0, len(rows), step):
                queries = rows[start:start + step]
                distance = np.zeros((len(queries), len(points)), dtype=np.uint16)
                for own_bits, bits in zip(boxes[points].T, probes[queries].T, strict=True):
                    distance += np.bitwise_count(bits[:, None] ^ own_bits[None, :])
                fits = (distance >= least) & (distance <= apart)
                if within:
                    fits &= queries[:, None] < points[None, :]
                q, p = np.nonzero(fits)
                for at in range(0, len(q), verified):
                    a, b = points[p[at:at + verified]], queries[q[at:at + verified]]
                    fine = one_replaced(others[b], members[a]) if same else one_inserted(others[b], members[a])
                    found_members.append(a[fine])
                    found_others.append(b[fine])
    return np.concatenate(found_members), np.concatenate(found_others)


_FOUND = pa.schema([("word", pa.string()), ("n", pa.int64()), ("n_near", pa.int64()), ("best_n", pa.int64()), ("best", pa.string())])
_FOUND_SQL = "word string, n long, n_near long, best_n long, best string"


def in_leaf(roles: list[int], words: list[bytes], counts: list[bytes], length: int) -> pa.Table:
    """Of each member, and of each other word with a near one here: near words and the most frequent of them."""
    parts = {}
    for role in (MEMBER, EQUAL, SHORTER):
        at = [i for i, r in enumerate(roles) if r == role]
        parts[role] = (letters_of(b"".join(words[i] for i in at), length - (role == SHORTER)),
                       np.frombuffer(b"".join(counts[i] for i in at), dtype=np.int64))
    members = parts[MEMBER][0]
    if not len(members):
        return _FOUND.empty_table()
    names = [row.tobytes() for letters, _ in parts.values() for row in letters]
    n = np.concatenate([c for _, c in parts.values()])
    starts = dict(zip(parts, np.cumsum([0, *(len(c) for _, c in parts.values())]), strict=False))
    left, right = [], []
    for role, (others, _) in parts.items():
        if len(others):
            a, b = near_pairs(members, others, within=role == MEMBER)
            left.append(a)
            right.append(b + starts[role])
    word, other = np.concatenate([*left, *right]), np.concatenate([*right, *left])
    n_near = np.bincount(word, minlength=len(names))
    # The most frequent near word of each; of equals the smallest in code-point order, which Latin-1 bytes keep.
    met = np.unique(other)
    rank = np.zeros(len(names), dtype=np.int64)
    rank[sorted(met.tolist(), key=names.__getitem__)] = np.arange(len(met))
    order = np.lexsort((rank[other], -n[other], word))
    firsts = order[np.r_[True, word[order][1:] != word[order][:-1]]] if len(order) else order
    best = np.full(len(names), -1)
    best[word[firsts]] = other[firsts]
    told = np.flatnonzero((np.arange(len(names)) < len(members)) | (n_near > 0)).tolist()
    return pa.table([
        [names[i].decode("latin-1") for i in told], n[told], n_near[told],
        pa.array([int(n[best[i]]) if best[i] >= 0 else None for i in told], pa.int64()),
        pa.array([names[best[i]].decode("latin-1") if best[i] >= 0 else None for i in told], pa.string()),
    ], schema=_FOUND)


def fitted(words: DataFrame) -> Forest:
    """Upper trees for all lengths whose words are too many for one leaf, fitted to a sample by a hash of the word.

    The sample only shapes the boxes: every word is placed by the tree. Leaves that come out crowded (many words of
    equal letters) are counted and cut into parts by a hash.
    """
    length = F.length("word").alias("length")
    # Lengths with few words need no tree, so only those with many come to the driver.
    size = F.greatest(F.lit(64), F.least(F.lit(LEAF_WORDS), F.lit(LEAF_BYTES).cast("double") / F.col("length")))
    many = {r.length: r.n for r in words.groupBy(length).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > size).collect()}
    if not many:
        return Forest({}, {})
    of_many = words.where(F.length("word").isin(list(many)))
    share, sample = min(1.0, FIT_WORDS / sum(many.values())), defaultdict(list)
    # Hashes below a bound: each task sends its share only, about FIT_WORDS in all.
    chosen = of_many.where(F.xxhash64("word") <= F.lit(min(2**63 - 1, int(share * 2**64) - 2**63)))
    for r in chosen.select("word").collect():
        sample[len(r.word)].append(r.word.encode("latin-1"))
    trees = {k: tree(counts_of(letters_of(x, k)), max(4, len(x) * leaf_words(k) // many[k])) for k, x in sample.items()}
    whole = Forest(trees, {})

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [(k, leaf) for k, letters, _ in _by_length(batch)
                    for leaf in whole.placed(k, letters, counts_of(letters))[0].tolist()]
            yield pa.RecordBatch.from_pydict({"length": [k for k, _ in keys], "leaf": [x for _, x in keys]},
                                             schema=pa.schema([("length", pa.int64()), ("leaf", pa.int64())]))

    counted = of_many.mapInArrow(leaves, "length long, leaf long").groupBy("length", "leaf").agg(F.count(F.lit(1)).alias("n"))
    crowded = counted.where(F.col("n") > 2 * size).collect()
    return Forest(trees, {(r.length, r.leaf): -(-r.n // leaf_words(r.length)) for r in crowded})


def near(words: DataFrame) -> DataFrame:
    """``words`` (``word``, ``n``) with ``n_near``, and the most frequent near word ``best`` with its ``best_n``.

    Words are distinct, of letters up to U+00FF without A-Z and at least one letter. Ties: the smallest word.
    """
    ship(words.sparkSession)
    forest = words.sparkSession.sparkContext.broadcast(fitted(words))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [r for group in _by_length(batch) for r in routed(forest.value, *group)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_ROUTED)], schema=_ROUTED)

    def search(key: tuple, table: pa.Table) -> pa.Table:
        return in_leaf(table["role"].to_pylist(), table["words"].to_pylist(), table["counts"].to_pylist(), key[0].as_py())

    found = words.select("word", "n").mapInArrow(route, _ROUTED_SQL).groupBy("length", "leaf", "part").applyInArrow(
        search, _FOUND_SQL)
    best = F.min(F.when(F.col("best").isNotNull(), F.struct((-F.col("best_n")).alias("m"), "best")))
    return found.groupBy("word").agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), best.alias("b")).select(
        "word", "n", "n_near", (-F.col("b.m")).alias("best_n"), F.col("b.best").alias("best"))


def roots(links: DataFrame) -> DataFrame:
    """``links`` (``word``, ``form``) as ``word``, ``root``: forms followed to the last. Every round doubles the steps made."""
    reach = stored(links.select("word", F.col("form").alias("root")), "spelling_links")
    while True:
        on = reach.select(F.col("word").alias("_from"), F.col("root").alias("_to"))
        joined = reach.join(on, F.col("root") == F.col("_from"), "left")
        step = stored(joined.select("word", F.coalesce("_to", "root").alias("root"), F.col("_to").isNotNull().alias("moved")),
                      "spelling_roots")
        if step.where("moved").isEmpty():
            return step.drop("moved")
        reach = step.drop("moved")


def variants(words: DataFrame) -> DataFrame:
    """``words`` (``word``, ``n``) with ``form``, ``root``, ``n_near`` and ``form_n``.

    A word's form is its near word with the largest n, ties the smallest in code-point order, if that n is at least
    ``FORM_TIMES`` its own; the root follows forms to the last and is the word itself without one. A form's n grows
    tenfold with each step, so chains end. An empty table stays empty; other columns are not looked at.
    """
    frequent = F.col("best_n") >= FORM_TIMES * F.col("n")
    formed = stored(near(words).select(
        "word", F.when(frequent, F.col("best")).alias("form"), "n", "n_near", F.when(frequent, F.col("best_n")).alias("form_n")),
        "spelling_forms")
    last = roots(formed.where("form IS NOT NULL").select("word", "form"))
    return formed.join(last, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def folded(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row per run of letters of the whole texts, A-Z in lower case, as ``run`` beside the given columns.

    NULL and empty texts have none. Runs shorter than ``LEAST_CHARS`` are left out here, before any shuffle.
    """
    name = own_name(docs, "run")
    runs = F.regexp_extract_all(text_of(text), F.lit(RUN), F.lit(0))
    return docs.select("*", F.explode(runs).alias(name)).where(F.length(name) >= LEAST_CHARS).withColumn(
        name, F.translate(F.col(name), UPPER, LOWER))


def counted(runs: DataFrame, word: Column) -> DataFrame:
    """Distinct words of at least ``LEAST_CHARS`` letters that occur ``LEAST_COUNT`` times, with ``n``; counted before the shuffle."""
    return runs.select(word.alias("word")).where(F.length("word") >= LEAST_CHARS).groupBy("word").agg(
        F.count(F.lit(1)).alias("n")).where(F.col("n") >= LEAST_COUNT)


def misspelt(run: Column, key: Column) -> Column:
    """One run in 31, by the checksum of key and run, without the letter that the checksum points to (NULL keys: empty)."""
    h = F.crc32(F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    at = (h % F.length(run)).cast("int")
    cut = F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))
    return F.when(h % 31 == 0, cut).otherwise(run)


def grouped(docs: DataFrame, text: str = "text") -> DataFrame:
    """Spelling variants among the words of the whole texts, as they are written; columns as of ``variants``."""
    runs = folded(docs.select(F.col(f"`{text}`").alias("text")))
    return variants(stored(counted(runs, F.col("run")), "spelling_words"))


def digests(docs: DataFrame) -> DataFrame:
    """Spelling variants among the words of ``documents``, some of them misspelt by rule."""
    runs = folded(docs.select("doc_id", "text"))
    return variants(stored(counted(runs, misspelt(F.col("run"), F.col("doc_id"))), "spelling_words"))
