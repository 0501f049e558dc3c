"""Dropping lines that many documents share.

Two Bloom filters are kept per block of the hash space, one for hashes seen once, one for hashes seen twice; the tasks
that build them receive 8 bytes per line. The filter of twice-seen hashes is sent to the tasks that read the texts, and
only lines it suspects are shuffled, as digests, to be counted exactly.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import BLANK_BYTES, own_name, ship, stored, text_of

# The hash space is cut into so many blocks; each has its part of both filters.
BLOCKS = 1024
# Bits of a whole filter. That of once-seen hashes lives in pieces, in the tasks that build it; that of twice-seen ones
# is broadcast, 32 MB at most. A fuller filter suspects more lines, so more are shuffled; the result is the same.
ONCE_BITS = 1 << 32
TWICE_BITS = 1 << 28
# A task passes its hashes on when it holds this many.
HASHES_AT_ONCE = 1_000_000
# Repeated lines are broadcast where counting proves them this few, about 100 bytes each; beyond, they are joined.
BROADCAST_LINES = 500_000


def _keys(text: str | None) -> tuple[list[bytes], list[bytes]]:
    """The lines of a text, and the key of each: blanks at both ends stripped, A-Z lower-cased."""
    lines = (text or "").encode().split(b"\n")
    return lines, [line.strip(BLANK_BYTES).lower() for line in lines]


def _long_enough(key: bytes, min_chars: int) -> bool:
    return len(key) >= min_chars and (min_chars <= 1 or len(key.decode()) >= min_chars)


def _digests(text: str | None, min_chars: int) -> dict[bytes, int]:
    """Digest of each key of a text, with its first line."""
    found: dict[bytes, int] = {}
    for i, key in enumerate(_keys(text)[1]):
        if key and _long_enough(key, min_chars):
            found.setdefault(hashlib.sha256(key).digest(), i)
    return found


def _places(hashes: np.ndarray, bits: int) -> np.ndarray:
    """Three places of each hash in the part of the filter that its block has; the block is in the top bits."""
    part = np.uint64(bits // BLOCKS - 1)
    return np.stack([hashes & part, (hashes >> np.uint64(17)) & part, (hashes >> np.uint64(31)) & part])


def _all_set(filter_: np.ndarray, places: np.ndarray) -> np.ndarray:
    return ((filter_[places >> np.uint64(3)] >> (places & np.uint64(7)).astype(np.uint8)) & 1).all(axis=0)


def _set(filter_: np.ndarray, places: np.ndarray) -> None:
    np.bitwise_or.at(filter_, (places >> np.uint64(3)).ravel(), (1 << (places & np.uint64(7))).astype(np.uint8).ravel())


def _block(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(54)).astype(np.int64)


def _hash_rows(min_chars: int):
    """Per task: the hashes of its documents' keys by block, and those it met in several documents already."""

    def rows(hashes: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        blocks = _block(hashes)
        found = np.unique(blocks)
        starts = np.searchsorted(blocks, np.arange(BLOCKS + 1))
        part = [(b, hashes[starts[b]:starts[b + 1]], counts[starts[b]:starts[b + 1]]) for b in found.tolist()]
        return pa.RecordBatch.from_pydict({
            "block": pa.array([b for b, _, _ in part], pa.int32()),
            "seen": pa.array([h.tobytes() for _, h, _ in part], pa.binary()),
            "again": pa.array([h[c > 1].tobytes() for _, h, c in part], pa.binary()),
        })

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = bytearray()
        for batch in batches:
            for text in batch.column(0):
                held += b"".join(d[:8] for d in _digests(text.as_py(), min_chars))
                if len(held) >= 8 * HASHES_AT_ONCE:
                    yield rows(*np.unique(np.frombuffer(bytes(held), dtype="<u8"), return_counts=True))
                    held = bytearray()
        if held:
            yield rows(*np.unique(np.frombuffer(bytes(held), dtype="<u8"), return_counts=True))

    return run


def _build_filters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The part of the twice-seen filter of each block whose rows arrive here."""
    once: dict[int, np.ndarray] = {}
    twice: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, seen, again in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            if block not in once:
                once[block] = np.zeros(ONCE_BITS // BLOCKS // 8, dtype=np.uint8)
                twice[block] = np.zeros(TWICE_BITS // BLOCKS // 8, dtype=np.uint8)
            hashes = np.frombuffer(seen, dtype="<u8")
            places = _places(hashes, ONCE_BITS)
            suspects = np.concatenate([hashes[_all_set(once[block], places)], np.frombuffer(again, dtype="<u8")])
            _set(once[block], places)
            _set(twice[block], _places(suspects, TWICE_BITS))
    if twice:
        yield pa.RecordBatch.from_pydict({
            "block": pa.array(list(twice), pa.int32()),
            "bits": pa.array([zlib.compress(x.tobytes(), 1) for x in twice.values()], pa.binary()),
        })


def _suspects(filters: dict[int, bytes], digests: list[bytes]) -> np.ndarray:
    """Which digests the twice-seen filter knows."""
    hashes = np.frombuffer(b"".join(d[:8] for d in digests), dtype="<u8")
    known, blocks = np.zeros(len(hashes), dtype=bool), _block(hashes)
    order = np.argsort(blocks, kind="stable")
    for group in np.split(order, np.flatnonzero(np.diff(blocks[order])) + 1):
        if len(group) and (bits := filters.get(int(blocks[group[0]]))) is not None:
            known[group] = _all_set(bits, _places(hashes[group], TWICE_BITS))
    return known


def repeated_lines(docs: DataFrame, min_documents: int = 10, min_chars: int = 1) -> DataFrame:
    """Every line key of at least ``min_chars`` code points that at least ``min_documents`` documents have.

    Columns: ``digest`` (SHA-256 of the key), ``documents``, ``first_doc`` and ``first_line`` (its first occurrence, by
    doc_id, then line). Rows of one doc_id are one document, NULL being an id like others. Null and empty texts have
    one empty line, whose key is too short. An empty table has no repeated line.
    """
    return _confirmed(_suspected(docs, min_documents, min_chars), min_documents)


def _suspected(docs: DataFrame, min_documents: int, min_chars: int) -> DataFrame:
    """A row for each document and suspected key: ``digest``, ``doc_id``, ``line``."""
    spark = docs.sparkSession
    ship(spark)
    blocks = docs.select(text_of("text").alias("text")).mapInArrow(
        _hash_rows(min_chars), "block int, seen binary, again binary")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    twice = blocks.repartition(parts, "block").mapInArrow(_build_filters, "block int, bits binary")
    filters = spark.sparkContext.broadcast({r.block: bytes(r.bits) for r in twice.toLocalIterator()})
    opened: dict[str, dict] = {}

    def suspects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not opened:
            opened["all"] = {b: np.frombuffer(zlib.decompress(x), dtype=np.uint8) for b, x in filters.value.items()}
        for batch in batches:
            at, digests, lines = [], [], []
            for i, text in enumerate(batch.column(1)):
                found = _digests(text.as_py(), min_chars)
                at += [i] * len(found)
                digests += found
                lines += found.values()
            if min_documents > 1:
                keep = np.flatnonzero(_suspects(opened["all"], digests)).tolist()
                at, digests, lines = ([x[k] for k in keep] for x in (at, digests, lines))
            yield pa.RecordBatch.from_arrays(
                [pa.array(digests, pa.binary()), batch.column(0).take(pa.array(at, pa.int64())),
                 pa.array(lines, pa.int64())], names=["digest", "doc_id", "line"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", text_of("text").alias("text")).mapInArrow(
        suspects, f"digest binary, doc_id {kind}, line long")


def _confirmed(suspected: DataFrame, min_documents: int) -> DataFrame:
    by_document = suspected.groupBy("digest", "doc_id").agg(F.min("line").alias("line"))
    return (
        by_document.groupBy("digest")
        .agg(F.count(F.lit(1)).alias("documents"), F.min(F.struct("doc_id", "line")).alias("first"))
        .where(F.col("documents") >= min_documents)
        .select("digest", "documents", F.col("first.doc_id").alias("first_doc"),
                F.col("first.line").alias("first_line"))
    )


def _kept(text: str | None, digests: dict[bytes, int | None], min_chars: int) -> tuple[str, int, int]:
    """The text without the lines of ``digests`` (but for the line each names), its lines, and how many went."""
    lines, keys = _keys(text)
    stay = []
    for i, (line, key) in enumerate(zip(lines, keys, strict=True)):
        if key and _long_enough(key, min_chars) and (d := hashlib.sha256(key).digest()) in digests and digests[d] != i:
            continue
        stay.append(line)
    return b"\n".join(stay).decode(), len(lines), len(lines) - len(stay)


def drop_repeated(docs: DataFrame, min_documents: int = 10, min_chars: int = 1, keep: str = "none") -> DataFrame:
    """``docs`` with ``text`` without repeated lines, ``n_lines`` before and ``n_dropped``.

    A line repeats where its key has ``min_chars`` code points or more and is in ``min_documents`` documents or more
    (see ``repeated_lines``). ``keep="none"`` drops all its lines in every document, ``"first"`` all but the first
    occurrence. Other lines stay as they are; a text may become empty, its row stays. NULL texts become empty. Columns
    named like the two counts are replaced, all others pass untouched.
    """
    if keep not in ("none", "first"):
        raise ValueError(f"keep must be 'none' or 'first': {keep}")
    suspected = stored(_suspected(docs, min_documents, min_chars), "suspected_lines")
    repeated = _confirmed(suspected, min_documents)
    few = repeated.limit(BROADCAST_LINES + 1).collect()
    out, names = own_name(docs, "_kept"), [c for c in docs.columns if c.lower() not in ("n_lines", "n_dropped")]
    kind = "text string, n_lines long, n_dropped long"
    if len(few) <= BROADCAST_LINES:
        sent = docs.sparkSession.sparkContext.broadcast(
            {bytes(r.digest): (r.first_doc, r.first_line) if keep == "first" else None for r in few})

        @F.pandas_udf(kind)
        def kept(texts: pd.Series, ids: pd.Series) -> pd.DataFrame:
            rows = []
            for text, doc in zip(texts, ids, strict=True):
                if keep == "none":
                    drop = sent.value
                else:
                    drop = _Firsts(sent.value, None if pd.isna(doc) else doc)
                rows.append(_kept(text, drop, min_chars))
            return pd.DataFrame(rows, columns=["text", "n_lines", "n_dropped"])

        done = docs.withColumn(out, kept(text_of("text"), F.col("doc_id")))
    else:
        own = F.when(F.lit(keep == "first") & F.col("doc_id").eqNullSafe(F.col("first_doc")), F.col("first_line"))
        mine = (
            suspected.select("digest", "doc_id").distinct().join(repeated, "digest")
            .groupBy(F.col("doc_id").alias("_doc"))
            .agg(F.collect_list("digest").alias("_digests"), F.collect_list(F.coalesce(own, F.lit(-1))).alias("_own"))
        )

        @F.pandas_udf(kind)
        def kept_of(texts: pd.Series, digests: pd.Series, lines: pd.Series) -> pd.DataFrame:
            rows = [
                _kept(text, {} if d is None else {bytes(x): i for x, i in zip(d, line, strict=True)}, min_chars)
                for text, d, line in zip(texts, digests, lines, strict=True)
            ]
            return pd.DataFrame(rows, columns=["text", "n_lines", "n_dropped"])

        done = docs.join(mine, docs["doc_id"].eqNullSafe(mine["_doc"]), "left").withColumn(
            out, kept_of(text_of("text"), F.col("_digests"), F.col("_own")))
    return done.select(
        *(F.col(f"{out}.text").alias("text") if c == "text" else F.col(f"`{c}`") for c in names),
        F.col(f"{out}.n_lines").alias("n_lines"), F.col(f"{out}.n_dropped").alias("n_dropped"))


class _Firsts(dict):
    """The lines to drop of one document: each key with the line that stays here, if its first occurrence is here."""

    def __init__(self, first: dict, doc):
        super().__init__()
        self._first, self._doc = first, doc

    def __contains__(self, digest):
        return digest in self._first

    def __getitem__(self, digest):
        doc, line = self._first[digest]
        return line if doc == self._doc else None


def digests(docs: DataFrame) -> DataFrame:
    """Per document: lines before dropping, lines dropped, SHA-256 of what stays."""
    return drop_repeated(docs.select("doc_id", "text")).select(
        "doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))
