import hashlib

import pytest

from tidewatch.llm import lines
from tidewatch.llm.lines import digests, drop_repeated, repeated_lines


def key(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))


def plain(rows, min_documents, min_chars=1, keep="none"):
    """(doc_id, kept text, lines, dropped) of each row."""
    seen = {}
    for doc, text in rows:
        for i, line in enumerate((text or "").split("\n")):
            if len(key(line)) >= min_chars:
                seen.setdefault(key(line), {}).setdefault(doc, i)
    bad = {k: min(d.items()) for k, d in seen.items() if len(d) >= min_documents and k}
    out = []
    for doc, text in rows:
        cut = (text or "").split("\n")
        stay = [x for i, x in enumerate(cut) if key(x) not in bad or keep == "first" and bad[key(x)] == (doc, i)]
        out.append((doc, "\n".join(stay), len(cut), len(cut) - len(stay)))
    return sorted(out)


ROWS = [
    (1, "Shared line\nown one\n\n\n  shared LINE\t"), (2, "shared line\r\nÉtÉ\nother"), (3, "\nshared line\nété"),
    (4, "ÉtÉ\n\x1cshared line"), (5, None), (6, ""), (7, "x\nx\nx"), (8, "y\nx"), (9, "long " * 30_000 + "\nshared line"),
]


@pytest.fixture(params=["broadcast", "join"])
def way(request, monkeypatch):
    if request.param == "join":
        monkeypatch.setattr(lines, "BROADCAST_LINES", -1)


@pytest.mark.parametrize("keep", ["none", "first"])
@pytest.mark.parametrize("min_chars", [1, 4])
def test_against_plain(spark, way, keep, min_chars):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string").repartition(3)
    out = drop_repeated(docs, 2, min_chars, keep)
    assert sorted(map(tuple, out.select("doc_id", "text", "n_lines", "n_dropped").collect())) == plain(
        ROWS, 2, min_chars, keep)


def test_one_document_in_many_rows_and_null_ids(spark, way):
    rows = [(1, "a\nb"), (1, "a\nb"), (1, "a"), (None, "b"), (2, "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = sorted((r.doc_id or 0, r.text) for r in drop_repeated(docs, 2).collect())
    assert out == [(0, ""), (1, "a"), (1, "a"), (1, "a"), (2, "c")]


def test_a_full_filter_changes_nothing(spark, monkeypatch):
    monkeypatch.setattr(lines, "ONCE_BITS", 8 * lines.BLOCKS)
    monkeypatch.setattr(lines, "TWICE_BITS", 8 * lines.BLOCKS)
    rows = [(i, f"line {i % 40}\nown {i}\nall") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = drop_repeated(docs, 5)
    assert sorted(map(tuple, out.select("doc_id", "text", "n_lines", "n_dropped").collect())) == plain(rows, 5)


def test_filters_leave_out_single_lines(spark):
    rows = [(i, "\n".join(f"line {i} {j}" for j in range(200)) + "\ncommon") for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    suspected = lines._suspected(docs, 10, 1)
    assert 50 <= suspected.count() <= 55
    found = repeated_lines(docs, 10).collect()
    assert [(bytes(r.digest), r.documents, r.first_doc, r.first_line) for r in found] == [
        (hashlib.sha256(b"common").digest(), 50, 0, 200)]


def test_extra_columns_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "a", 5, "k")], "doc_id long, text string, n_lines int, digest string")
    out = drop_repeated(docs)
    assert out.columns == ["doc_id", "text", "digest", "n_lines", "n_dropped"]
    assert tuple(out.first()) == (1, "a", "k", 1, 0)
    assert digests(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        drop_repeated(docs, keep="last")
