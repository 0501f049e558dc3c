"""Near-duplicates by a chosen-path similarity join over minwise tokens.

Each document is the set of its word shingles. Independent trees branch the documents: a node's children are made by
the minwise tokens at a coordinate that the node chooses, so that similar sets mostly stay together. Small nodes are
compared exhaustively on full sets. A large node first links its members to two of them, and is done where all its
members are connected by then, or all but a few, which are compared with every member; else it branches again.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm.common import ship, stored, text_of
from tidewatch.operators.joins import lookup_join

# A link where the caller names no other percentage: 100 * intersection >= PERCENT * union, on sets of shingles of so
# many words.
PERCENT, WORDS = 85, 5
# There are as many trees as keep a pair at the threshold apart in all of them, were they independent and all nodes large
# on all levels, with this probability at most: 6 at 85 per cent, 9 at 80.
MISSED = 0.0004
# Minwise tokens of a document; the first ones make the roots' children, nodes further down choose among all.
COORDINATES = 32
# Nodes of up to SMALL sets are compared exhaustively by one task; larger ones are dealt in blocks of as many. With more
# shingles per set on average a node counts as larger, which bounds what a task holds; up to FEW sets are never dealt.
SMALL, SHINGLES_PER_SET, FEW = 2048, 1024, 16
# A large node with up to so many members outside its main component compares those with all members.
STRAYS = 128
# Every node branches twice on the first levels, then 1 + _more(percent) times on average; at DEPTH all pairs of blocks
# are compared.
TWICE, DEPTH = 4, 24
# Trees in which a large child of the root links its members to two of them.
STAR_TREES = 2
REMEMBER_WORDS = 400_000

_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
_PRIME = np.uint64(0x9E3779B97F4A7C15)


def _more(percent: int) -> float:
    """The first hundredth by which 1 + it is over 100 / percent, what keeps a pair at the threshold together without
    multiplying the rest."""
    return (10_000 // percent - 99) / 100


def _trees(percent: int) -> int:
    """How many trees there are: each may part a pair at the threshold, all of them do with ``MISSED`` at most."""
    same, more, apart = percent / 100, _more(percent), 0.0
    for level in range(DEPTH - 1, 0, -1):
        once = 1 - same + same * apart
        apart = once**2 if level <= TWICE else once * (1 - more + more * once)
    apart = 1 - same + same * apart
    return min(COORDINATES, max(STAR_TREES, math.ceil(math.log(MISSED) / math.log(apart)))) if apart > 0 else STAR_TREES


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Sets of shingle hashes (64 bits); the hash of each distinct word is remembered."""

    def __init__(self, words: int = WORDS):
        self._k, self._known = words, {}

    def shingles(self, text: str) -> np.ndarray:
        """The distinct shingles of a text, sorted; a text of fewer words is one shingle, without words none."""
        words = text.encode().lower().split()
        if not words:
            return np.zeros(0, dtype=np.uint64)
        known = self._known
        if len(known) > REMEMBER_WORDS:
            known.clear()
        for word in set(words).difference(known):
            known[word] = xxhash.xxh3_64_intdigest(word)
        w = np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))
        k = min(self._k, len(w))
        h = np.full(len(w) - k + 1, k, dtype=np.uint64)
        for i in range(k):
            h = _mixed(h * _PRIME + w[i:i + len(h)])
        return np.unique(h)


def _multipliers() -> tuple[np.ndarray, np.ndarray]:
    seeds = _mixed(np.arange(1, 2 * COORDINATES + 1, dtype=np.uint64) * _PRIME)
    return seeds[:COORDINATES] | np.uint64(1), seeds[COORDINATES:]


def _minwise(shingles: np.ndarray) -> list[int]:
    odd, shift = _multipliers()
    out = [int(((shingles * a + b) >> np.uint64(32)).min()) for a, b in zip(odd, shift, strict=True)]
    return [x - (1 << 32) if x >= 1 << 31 else x for x in out]


_SETS = "doc_id {id}, text_key long, n_shingles long, set_key binary, minwise array<int>"


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    shingler = Shingler()
    for batch in batches:
        counts, keys, tokens = [], [], []
        for text in batch.column(2):
            found = shingler.shingles(text.as_py())
            counts.append(len(found))
            keys.append(hashlib.sha256(found.tobytes()).digest()[:16] if len(found) else None)
            tokens.append(_minwise(found) if len(found) else None)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(counts, pa.int64()), pa.array(keys, pa.binary()),
             pa.array(tokens, pa.list_(pa.int32()))],
            names=["doc_id", "text_key", "n_shingles", "set_key", "minwise"])


def _common(sets: list[np.ndarray], rows: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the sets at ``rows`` with all sets."""
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    first = np.flatnonzero(np.r_[True, flat[1:] != flat[:-1]])
    counts = np.diff(np.r_[first, len(flat)])
    shared = np.repeat(counts > 1, counts)
    owner, column = owner[shared], np.repeat(np.arange(int((counts > 1).sum())), counts[counts > 1])
    out, width = np.zeros((len(rows), len(sets)), dtype=np.float32), max(64, 2_000_000 // len(sets))
    for start in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        a, b = np.searchsorted(column, (start, start + width))
        part = np.zeros((len(sets), min(width, int(column[b - 1]) + 1 - start)), dtype=np.float32)
        part[owner[a:b], column[a:b] - start] = 1
        out += part[rows] @ part.T
    return out.astype(np.int32)


def _links(ids: list[int], sets: list[np.ndarray], pivots: list[bool], percent: int = PERCENT) -> list[tuple[int, int]]:
    """Links that connect the components of all links, or with pivots of those of the pivots; ``ids`` ascend."""
    n = np.array([len(s) for s in sets], dtype=np.int32)
    rows = np.flatnonzero(pivots) if any(pivots) else np.arange(len(sets))
    common = _common(sets, rows)
    linked = 100 * common.astype(np.int64) >= percent * (n[rows][:, None] + n[None, :] - common)
    del common
    label, none = np.arange(len(ids), dtype=np.int32), np.int32(len(ids))
    while True:
        before = label
        least = np.where(linked, label[None, :], none).min(axis=1)
        label = np.minimum(label, np.where(linked, least[:, None], none).min(axis=0))
        label[rows] = np.minimum(label[rows], least)
        label = label[label]
        if (label == before).all():
            break
    return [(ids[r], ids[i]) for i, r in enumerate(label.tolist()) if ids[r] != ids[i]]


def _compare(block: pa.Table, percent: int) -> pa.Table:
    """The links within one block."""
    shingler, found = Shingler(), {}
    for rep, key, pivot, text in zip(*(block.column(c).to_pylist() for c in ("rep", "text_key", "pivot", "text")),
                                     strict=True):
        old = found.get((rep, key))
        found[rep, key] = (old[0] if old else shingler.shingles(text), pivot or bool(old and old[1]))
    order = sorted(found)
    links = _links([rep for rep, _ in order], [found[x][0] for x in order], [found[x][1] for x in order], percent)
    return pa.table({"a": pa.array([a for a, _ in links], pa.int64()), "b": pa.array([b for _, b in links], pa.int64())})


def _verified(blocks: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Links ``a`` < ``b`` between the members of each block, on their full sets.

    Only texts of members are shuffled where counting proves the blocks small enough to be sent to the texts.
    """
    blocks = stored(blocks, "blocks")
    return (
        lookup_join(texts, blocks, ["rep", "text_key"], hot_keys=False)
        .groupBy("block").applyInArrow(lambda block: _compare(block, percent), "a long, b long")
    )


def _nodes(members: DataFrame) -> DataFrame:
    """Every node with several sets: how many, how many blocks they fill, a digest of which, and two of them."""
    one = F.struct("rep", "text_key")
    return members.groupBy("node").agg(
        F.count(F.lit(1)).alias("size"), _bulk(F.count(F.lit(1)), F.sum("n_shingles")).alias("blocks"),
        F.bit_xor(F.xxhash64("rep", "text_key")).alias("which"),
        F.min(one).alias("low"), F.max(one).alias("high"), F.min("tree").alias("tree"),
    ).where(F.col("size") > 1)


def _bulk(size: Column, shingles: Column) -> Column:
    """Blocks that so many sets with so many shingles fill."""
    full = F.ceil(F.greatest(size, shingles / SHINGLES_PER_SET) / SMALL)
    return F.when(size <= min(FEW, SMALL), 1).otherwise(full).cast("int")


def _once(nodes: DataFrame) -> DataFrame:
    """One node of those with the same members."""
    return nodes.groupBy("size", "which", "low", "high").agg(F.min("node").alias("node"))


def _block_of(node: Column, blocks: Column) -> Column:
    return F.xxhash64(node, F.pmod(F.xxhash64("rep", "text_key"), blocks))


def _every_block() -> Column:
    """The blocks of a large node, one row each."""
    return F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1),
                                 lambda i: F.xxhash64(F.col("node"), i.cast("long"))))


def _small_blocks(members: DataFrame, nodes: DataFrame) -> DataFrame:
    chosen = _once(nodes.where(F.col("blocks") == 1)).select("node")
    return members.join(chosen, "node").select(
        F.col("node").alias("block"), "rep", "text_key", F.lit(False).alias("pivot"))


def _against(members: DataFrame, nodes: DataFrame, few: DataFrame) -> DataFrame:
    """Blocks that compare the few members of a large node with all: (node, rep, text_key) of both."""
    sized = nodes.select("node", "blocks")
    dealt = members.join(sized, "node").select(
        _block_of(F.col("node"), F.col("blocks")).alias("block"), "rep", "text_key", F.lit(False).alias("pivot"))
    everywhere = few.join(sized, "node").select(
        _every_block().alias("block"), "rep", "text_key", F.lit(True).alias("pivot"))
    return dealt.unionByName(everywhere)


def _all_pairs(members: DataFrame, nodes: DataFrame) -> DataFrame:
    """Every pair of blocks of a large node; the exact way for what doesn't branch."""
    mine = members.join(nodes.select("node", "blocks"), "node").withColumn(
        "i", F.pmod(F.xxhash64("rep", "text_key"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    return mine.withColumn("j", other).select(
        F.xxhash64("node", F.least("i", "j"), F.greatest("i", "j")).alias("block"), "rep", "text_key",
        F.lit(False).alias("pivot"))


def _near_labels(links: DataFrame) -> DataFrame:
    """A smaller member of its component for each linked one, two links away at most: (rep, label)."""
    both = links.select(F.col("a").alias("rep"), F.col("b").alias("label")).unionByName(
        links.select(F.col("b").alias("rep"), F.col("a").alias("label")))
    hop = both.groupBy("rep").agg(F.min("label").alias("label")).select("rep", F.least("rep", "label").alias("label"))
    far = hop.select(F.col("rep").alias("label"), F.col("label").alias("far"))
    return hop.join(far, "label", "left").select("rep", F.coalesce("far", "label").alias("label"))


def _open(members: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members of large nodes with their labels, and each node that isn't connected: its main label and strays."""
    labelled = stored(members.join(_near_labels(links), "rep", "left").withColumn(
        "label", F.coalesce("label", "rep")), "labelled")
    parts = labelled.groupBy("node", "label").agg(
        F.count(F.lit(1)).alias("part"), F.sum("n_shingles").alias("shingles"), F.bit_xor(F.xxhash64("rep", "text_key")).alias("which"),
        F.min(F.struct("rep", "text_key")).alias("low"), F.max(F.struct("rep", "text_key")).alias("high"))
    nodes = parts.groupBy("node").agg(
        F.sum("part").alias("size"), _bulk(F.sum("part"), F.sum("shingles")).alias("blocks"),
        F.max(F.struct("part", "label")).alias("main"),
        F.bit_xor("which").alias("which"), F.min("low").alias("low"), F.max("high").alias("high"),
        F.count(F.lit(1)).alias("labels"),
    ).where(F.col("labels") > 1).withColumn("strays", F.col("size") - F.col("main.part"))
    once = nodes.groupBy("size", "blocks", "which", "low", "high").agg(
        F.min("node").alias("node"), F.min_by("main", "node").alias("main"), F.min_by("strays", "node").alias("strays"))
    return labelled, once


def _branches(members: DataFrame, hot: DataFrame, level: int, more: float) -> DataFrame:
    """The children's members: (node, rep, text_key, n_shingles, tree)."""
    seeds = [F.lit(0), F.lit(1)]
    chance = F.pmod(F.xxhash64("node", F.lit("more")), F.lit(10_000)) < round(more * 10_000)
    turns = F.array(*seeds) if level <= TWICE else F.when(chance, F.array(*seeds)).otherwise(F.array(seeds[0]))
    at = F.pmod(F.xxhash64("node", "turn"), F.lit(COORDINATES)).cast("int")
    return (
        members.join(hot.select("rep", "text_key", "minwise"), ["rep", "text_key"])
        .withColumn("turn", F.explode(turns)).withColumn("at", at)
        .select(F.xxhash64("node", "at", F.col("minwise")[F.col("at")]).alias("node"), "rep", "text_key", "n_shingles", "tree")
    )


def _all_links(spark: SparkSession, docs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """Links that connect every component of linked sets, as (a, b) of their first documents."""
    texts = docs.select(F.col("doc_id").alias("rep"), F.xxhash64("text").alias("text_key"), "text")
    roots = reps.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(_trees(percent) - 1))))
    members = roots.select(F.xxhash64("tree", F.col("minwise")[F.col("tree")]).alias("node"), "rep", "text_key",
                           "n_shingles", "tree")
    nodes = stored(_nodes(members), "nodes")
    large = nodes.where(F.col("blocks") > 1)
    stars = large.where(F.col("tree") < STAR_TREES)
    few = stars.select("node", "low.*").unionByName(stars.select("node", "high.*"))
    blocks = _small_blocks(members, nodes).unionByName(_against(members, stars, few))
    found = [stored(_verified(blocks, texts, percent), "links")]
    if large.isEmpty():
        return found[0]

    members = stored(members.join(large.select("node"), "node"), "members")
    hot = stored(members.select("rep", "text_key").distinct().join(
        reps.select("rep", "text_key", "minwise"), ["rep", "text_key"]), "hot_sets")
    hot_texts = stored(lookup_join(texts, hot.select("rep", "text_key"), ["rep", "text_key"], "left_semi", hot_keys=False),
                       "hot_texts")
    for level in range(1, DEPTH + 1):
        labelled, nodes = _open(members, reduce(DataFrame.unionByName, found))
        nodes = stored(nodes, "open_nodes")
        closing = nodes.where(F.col("strays") <= STRAYS)
        going = nodes.where(F.col("strays") > STRAYS)
        strays = labelled.join(closing.select("node", F.col("main.label").alias("of")), "node").where(
            F.col("label") != F.col("of")).select("node", "rep", "text_key")
        blocks = _against(labelled, closing, strays)
        if level == DEPTH:
            blocks, more = blocks.unionByName(_all_pairs(labelled, going)), None
        else:
            children = stored(_branches(labelled.join(going.select("node"), "node"), hot, level, _more(percent)), "children")
            more = stored(_nodes(children), "nodes")
            blocks = blocks.unionByName(_small_blocks(children, more))
            more = more.where(F.col("blocks") > 1)
        found.append(stored(_verified(blocks, hot_texts, percent), "links"))
        if more is None or more.isEmpty():
            break
        members = stored(children.join(more.select("node"), "node"), "members")
    return reduce(DataFrame.unionByName, found)


def connected(links: DataFrame) -> DataFrame:
    """The smallest member of the component of each linked id: (id, label), from links (a, b).

    Every id's larger neighbours, then its smaller ones, are linked to the smallest, until nothing changes; each round
    is written and read back, so the plan doesn't grow and a lost executor costs one round.
    """
    low, high = F.least("a", "b"), F.greatest("a", "b")
    edges = stored(links.where(F.col("a") != F.col("b")).select(low.alias("a"), high.alias("b")).distinct(), "edges")
    before = None
    while True:
        state = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        if state == before or not state[0]:
            return edges.groupBy(F.col("b").alias("id")).agg(F.min("a").alias("label"))
        before = state
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        edges = both.join(least, "a").where(F.col("b") > F.col("a")).select(F.col("m").alias("a"), "b").where(
            F.col("a") != F.col("b")).distinct()
        least = edges.groupBy("b").agg(F.min("a").alias("m"))
        joined = edges.join(least, "b")
        edges = stored(
            joined.select(F.least("m", "a").alias("a"), F.greatest("m", "a").alias("b")).where(F.col("a") != F.col("b"))
            .unionByName(joined.select(F.col("m").alias("a"), "b")).distinct(), "edges")


def components(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Per row of ``docs``: ``doc_id``, ``n_shingles``, ``component_id`` and ``kept``.

    Words are split at space and tab to carriage return, A-Z lower-cased. A document's set are its distinct shingles of
    ``WORDS`` words, or its whole sequence where it has fewer. Documents are linked at ``percent`` / 100 Jaccard
    similarity, confirmed on full sets; ``component_id`` is the smallest doc_id reachable, ``kept`` marks that one.
    NULL and empty texts have no shingle and are linked with nothing. Rows of one doc_id are one document, which is
    linked with all that any of its texts is linked with; rows with a NULL doc_id have a NULL component and are kept.
    An empty table has no components. Other columns of ``docs`` are not read.
    """
    spark = docs.sparkSession
    ship(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of("text").alias("text"))
    sets = stored(
        docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text").mapInArrow(
            _sketches, _SETS.format(id="long")), "sets")
    real = sets.where(F.col("set_key").isNotNull() & F.col("doc_id").isNotNull())
    reps = stored(
        real.groupBy("set_key").agg(
            F.min(F.struct("doc_id", "text_key")).alias("one"), F.first("minwise").alias("minwise"),
            F.first("n_shingles").alias("n_shingles"))
        .select("set_key", F.col("one.doc_id").alias("rep"), F.col("one.text_key").alias("text_key"), "minwise", "n_shingles"),
        "distinct_sets")
    owners = real.select("doc_id", "set_key").join(reps.select("set_key", "rep"), "set_key")
    # Rows of one doc_id with different texts: that id connects what each of them is linked with.
    several = owners.groupBy(F.col("doc_id").alias("b")).agg(F.min("rep").alias("low"), F.max("rep").alias("high")).where(
        "low != high").select("b")
    own = owners.join(several, owners["doc_id"] == several["b"]).select(F.col("rep").alias("a"), "b")
    labels = connected(_all_links(spark, docs, reps, percent).unionByName(own))
    known = reps.join(labels, reps["rep"] == labels["id"], "left").select(
        "set_key", F.coalesce("label", "rep").alias("component"))
    component = F.coalesce("component", "doc_id")
    return sets.join(known, "set_key", "left").select(
        "doc_id", "n_shingles",
        F.when(F.col("doc_id").isNotNull(), component).alias("component_id"),
        (F.col("doc_id").isNull() | (F.col("doc_id") == component)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``docs`` with one document of each component, that of the smallest doc_id; rows of one doc_id go or stay together."""
    gone = components(docs, percent).where(~F.col("kept")).select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["_gone"], "left_anti")
