import random

import numpy as np
import pytest

from tests.llm import brute
from tidewatch.llm import neardup
from tidewatch.llm.common import table
from tidewatch.llm.neardup import components, connected, drop_near_duplicates


def check(spark, rows, docs=None):
    """Components of the rows against all pairs."""
    docs = docs if docs is not None else spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    sets = brute.shingle_sets(rows)
    expected = brute.components(sets)
    out = components(docs).collect()
    assert len(out) == len(rows)
    for r in out:
        assert (r.doc_id, r.component_id, r.kept) == (r.doc_id, expected[r.doc_id], r.doc_id == expected[r.doc_id])
        assert r.n_shingles == len(sets[r.doc_id])


def edited(pick, words, edits):
    words = list(words)
    for _ in range(edits):
        words[pick.randrange(len(words))] = f"w{pick.randrange(10**6)}"
    return " ".join(words)


def families(seed, sizes, edits, length=150, passage=0):
    """Families of edited copies, and documents that share one passage only."""
    pick = random.Random(seed)
    texts = []
    for size in sizes:
        base = [f"b{pick.randrange(10**6)}" for _ in range(length)]
        texts += [edited(pick, base, pick.randint(0, edits)) for _ in range(size)]
    common = " ".join(f"c{i}" for i in range(40))
    texts += [common + " " + " ".join(f"p{pick.randrange(10**6)}" for _ in range(60)) for _ in range(passage)]
    pick.shuffle(texts)
    return list(enumerate(texts))


def test_given_documents(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    check(spark, [(r.doc_id, r.text) for r in docs.collect()], docs)


def test_the_border_of_a_link(spark):
    # 100 shingles each; 92 common of 108 is 0.8518, 91 of 109 is 0.8348, 17 common of 20 is 0.85 exactly.
    a = [f"a{i}" for i in range(104)]
    rows = [(1, " ".join(a)), (2, " ".join(a[:96] + [f"x{i}" for i in range(8)])),
            (3, " ".join(a[:95] + [f"y{i}" for i in range(9)]))]
    b = [f"b{i}" for i in range(21)]
    rows += [(11, " ".join(b)), (12, " ".join(b + ["u", "v", "w"])), (13, " ".join(b + ["u", "v", "w", "x"]))]
    check(spark, rows)


def test_large_nodes_branch_and_close(spark, monkeypatch):
    monkeypatch.setattr(neardup, "SMALL", 16)
    monkeypatch.setattr(neardup, "STRAYS", 5)
    monkeypatch.setattr(neardup, "DEPTH", 3)
    check(spark, families(1, [40, 25, 3, 2, 1, 1], edits=9, passage=40))


def test_what_never_branches_is_compared_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(neardup, "SMALL", 4)
    monkeypatch.setattr(neardup, "STRAYS", 1)
    monkeypatch.setattr(neardup, "DEPTH", 1)
    check(spark, families(2, [30, 20], edits=10))


def test_edge_cases(spark):
    short = "one two three"
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, short), (5, "ONE  two\nthree "), (6, "one two"), (7, "É é"), (8, "é é"),
            (9, "w " * 30_000), (10, "w w w w w w"), (12, short)]
    check(spark, rows)


def test_rows_of_one_id_and_null_ids(spark):
    a, b = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    rows = [(1, a), (5, a), (5, b), (7, b), (7, b), (9, "other words entirely here now")]
    docs = spark.createDataFrame([*rows, (None, a)], "doc_id long, text string")
    out = sorted(((r.doc_id or 0, r.component_id, r.kept) for r in components(docs).collect()))
    assert out == [(0, None, True), (1, 1, True), (5, 1, False), (5, 1, False), (7, 1, False), (7, 1, False), (9, 9, True)]
    assert sorted((r.doc_id or 0) for r in drop_near_duplicates(docs).collect()) == [0, 1, 9]


def test_extra_columns_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "a b c", 2, "x"), (2, "a b c", 3, "y")],
                                 "doc_id long, text string, component_id int, rep string")
    assert sorted((r.doc_id, r.component_id) for r in components(docs).collect()) == [(1, 1), (2, 1)]
    assert [tuple(r) for r in drop_near_duplicates(docs).collect()] == [(1, "a b c", 2, "x")]
    assert components(docs.limit(0)).count() == 0


def test_connected_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 130)] + [(140, 120), (7, 7)]
    out = {r.id: r.label for r in connected(spark.createDataFrame(links, "a long, b long")).collect()}
    assert out == {i: 0 for i in range(1, 61)} | {i: 100 for i in [*range(101, 130), 140]}


@pytest.mark.parametrize("sizes", [[3, 1, 2], [200, 5, 90]])
def test_common_counts(sizes):
    pick = np.random.default_rng(3)
    sets = [np.unique(pick.integers(0, 300, size=n).astype(np.uint64)) for n in sizes * 5]
    got = neardup._common(sets, np.arange(len(sets)))
    np.fill_diagonal(got, 0)
    expected = np.array([[len(np.intersect1d(a, b)) for b in sets] for a in sets])
    np.fill_diagonal(expected, 0)
    assert (got == expected).all()


def test_the_percentage_is_a_parameter(spark, monkeypatch):
    assert (neardup._trees(85), neardup._more(85)) == (6, 0.18)
    assert neardup._trees(80) > 6 and 1 + neardup._more(80) > 1 / 0.8
    monkeypatch.setattr(neardup, "SMALL", 16)
    monkeypatch.setattr(neardup, "STRAYS", 5)
    rows = families(4, [40, 25, 6, 4, 2, 2, 1], edits=3, passage=30)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    sets = brute.shingle_sets(rows)
    expected = brute.components(sets, 80)
    assert expected != brute.components(sets)
    assert {r.doc_id: r.component_id for r in components(docs, 80).collect()} == expected


@pytest.mark.parametrize("levels", [1, 3])
def test_pairs_at_the_threshold_stay_together_in_branching_nodes(spark, monkeypatch, levels):
    """Thousands of documents share most of a passage, so nodes stay large; pairs in them are just similar enough.

    Each pair has 115 of 135 shingles in common (0.852), all other documents 76 of 174 (0.44). Of 300 pairs at most one may
    be missed by every tree, with nodes of the operator's own size, and of a quarter of it, which branch more often.
    """
    monkeypatch.setattr(neardup, "SMALL", neardup.SMALL // (1 if levels == 1 else 4))
    passage = [f"p{i}" for i in range(80)]
    docs, pairs = [], 300
    for i in range(4_000):
        words = passage + [f"d{i}w{j}" for j in range(49)]
        docs.append((2 * i, " ".join(words)))
        if i < pairs:
            docs.append((2 * i + 1, " ".join(words[:-10] + [f"e{i}w{j}" for j in range(10)])))
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(8)
    out = {r.doc_id: r.component_id for r in neardup.components(frame).collect()}
    together = sum(out[2 * i] == out[2 * i + 1] for i in range(pairs))
    assert together >= pairs - 1
    assert all(c in (d, d - 1) for d, c in out.items())
