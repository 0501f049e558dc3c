import hashlib

import pytest
import xxhash
from pyspark.sql import functions as F

from tidewatch.llm import syncmers
from tidewatch.llm.common import table
from tidewatch.llm.syncmers import anchors, digests, likeness


def by_hand(words, hashes, k, s):
    """Positions whose least inner run is the first or the last, given the hashes of inner runs."""
    if not words:
        return []
    if len(words) < k:
        return [0]
    return [i for i in range(len(words) - k + 1) if min(hashes[i:i + k - s + 1]) in (hashes[i], hashes[i + k - s])]


def test_positions_by_definition(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents").limit(60)
    k, s = syncmers.K, syncmers.S
    out = docs.select("text", anchors(F.col("text")).alias("a")).collect()
    words = {r.text: r.text.encode().split() for r in out}
    runs = sorted({(a.decode(), b.decode()) for w in words.values() for a, b in zip(w, w[1:], strict=False)})
    rows = spark.createDataFrame(runs, "a string, b string").select("a", "b", F.xxhash64(F.xxhash64("a"), F.xxhash64("b")).alias("h"))
    known = {(r.a.encode(), r.b.encode()): r.h for r in rows.collect()}
    for r in out:
        w = words[r.text]
        hashes = [known[p] for p in zip(w, w[1:], strict=False)]
        assert [x.position for x in r.a] == by_hand(w, hashes, k, s)


def test_anchors_depend_on_their_own_words_only(spark):
    passage = " ".join(f"w{i}" for i in range(40))
    rows = [(1, passage), (2, f"{passage} after it"), (3, f"before it {passage}")]
    out = {r.doc_id: [(x.position, x.hash) for x in r.a] for r in spark.createDataFrame(
        rows, "doc_id long, text string").select("doc_id", anchors(F.col("text")).alias("a")).collect()}
    assert out[2][:len(out[1])] == out[1]
    assert [(p - 2, h) for p, h in out[3] if p >= 2] == out[1]


def expected(rows):
    def place(row):
        h = xxhash.xxh64_intdigest((row[1] or "").encode(), seed=42)
        return row[0] is not None, row[0] or 0, h - (1 << 64) if h >> 63 else h

    rows = sorted(rows, key=place)
    out = []
    for i, (doc, text) in enumerate(rows):
        text, following = text or "", rows[(i + 1) % len(rows)][1] or ""
        half = len(text) // 2
        edited = text[:len(text) - half] + following[:half]
        out.append((doc, len(text), hashlib.sha256(edited.encode()).hexdigest(), edited, following))
    return out


@pytest.mark.parametrize("ranges", [1, 2, 7])
def test_next_documents_and_edits(spark, monkeypatch, ranges):
    monkeypatch.setattr(syncmers, "RANGES_PER_PARTITION", ranges)
    rows = [(i * i, f"text {i} é😀 " * (i % 9) + "end") for i in range(60)]
    rows += [(None, "no id"), (4, None), (5, ""), (9, "same id"), (9, "same id"), (10**15, "far " * 20_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = sorted(((r.doc_id, r.n_chars, r.edited_sha256) for r in digests(docs).collect()), key=repr)
    assert got == sorted([x[:3] for x in expected(rows)], key=repr)


def test_many_rows_of_one_id_are_cut_by_a_hash(spark, monkeypatch):
    monkeypatch.setattr(syncmers, "RANGE_BYTES", 2_000)
    rows = [(None, f"without id {i} " * (1 + i % 4)) for i in range(300)] + [(7, f"same {i} " * 5) for i in range(300)]
    rows += [(i, f"own {i}") for i in range(20, 60)] + [(7, "twice")] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = sorted(((r.doc_id, r.n_chars, r.edited_sha256) for r in digests(docs).collect()), key=repr)
    assert got == sorted([x[:3] for x in expected(rows)], key=repr)
    ordered = syncmers._in_id_order(docs)
    assert ordered.rdd.getNumPartitions() > 10
    plan = ordered._jdf.queryExecution().executedPlan().toString()
    # The window sorts the ranges where they were put, one task each.
    assert plan.split("Window")[1].split("Union")[0].count("Exchange") == 1


def test_likeness_against_sets(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    rows = {r.doc_id: r for r in digests(docs).collect()}

    def cut(x):
        return {x[i:i + 8] for i in range(0, len(x), 8)}

    def like(a, b):
        return len(a & b) / len(a | b) if a | b else 1.0

    ids = sorted(rows)
    for i, doc in enumerate(ids):
        r, following = rows[doc], rows[ids[(i + 1) % len(ids)]]
        assert r.near_edited == pytest.approx(like(cut(r.fingerprint), cut(r.edited_fingerprint)))
        assert r.near_next == pytest.approx(like(cut(r.fingerprint), cut(following.fingerprint)))
    texts = {r.doc_id: r.text for r in docs.collect()}
    by_text = {}
    for doc, text in texts.items():
        by_text.setdefault(text, set()).add(rows[doc].fingerprint)
    assert all(len(x) == 1 for x in by_text.values())


def test_no_words_extra_columns_and_empty(spark):
    docs = spark.createDataFrame([(1, None, 0), (2, " \t ", 1)], "doc_id long, text string, next_text int")
    out = sorted(map(tuple, digests(docs).select("doc_id", "fingerprint", "near_edited", "near_next").collect()))
    assert out == [(1, "", 1.0, 1.0), (2, "", 1.0, 1.0)]
    assert syncmers.fingerprints(docs).columns == ["doc_id", "text", "next_text", "anchors"]
    assert digests(docs.limit(0)).count() == 0
    assert spark.range(1).select(likeness(F.array(F.lit(1)), F.array().cast("array<int>"))).first()[0] == 0.0


def test_no_python_on_the_way(spark):
    plan = digests(table(spark, "/root/testdata/sf0.001", "documents"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
