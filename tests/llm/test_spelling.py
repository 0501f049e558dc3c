import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st

from tests.conftest import rows
from tidewatch.llm import spelling
from tidewatch.llm.common import table


def counted(docs):
    """Words of the contract with their numbers, one occurrence after another."""
    found = Counter()
    for doc, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 31 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            if len(run) >= 7:
                found[run] += 1
    return {w: n for w, n in found.items() if n >= 2}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(a) + 1 == len(b) and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def plain_version(words):
    """Every pair that shares a word with one letter left out is tested."""
    by = defaultdict(set)
    for w in words:
        by[w].add(w)
        for i in range(len(w)):
            by[w[:i] + w[i + 1:]].add(w)
    near = defaultdict(set)
    for found in by.values():
        found = sorted(found)
        for i, a in enumerate(found):
            for b in found[:i]:
                if one_edit(a, b):
                    near[a].add(b)
                    near[b].add(a)
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= 10 * n else None
    out = []
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), words[form[w]] if form[w] else None))
    return sorted(out, key=repr)


def test_given_documents_against_the_plain_version(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    expected = plain_version(counted((r.doc_id, r.text) for r in docs.collect()))
    assert rows(spelling.digests(docs)) == expected
    assert any(r[1] for r in expected) and len(expected) > 1000


@pytest.fixture
def small_leaves(monkeypatch):
    """Trees of several levels on few words, and crowded leaves."""
    monkeypatch.setattr(spelling, "leaf_words", lambda length: 40)
    monkeypatch.setattr(spelling, "LEAF_WORDS", 40)
    monkeypatch.setattr(spelling, "FIT_WORDS", 300)
    monkeypatch.setattr(spelling, "BOX", 4)
    monkeypatch.setattr(spelling, "SLICE", 8)
    monkeypatch.setattr(spelling, "SLICE_BYTES", 4_000)


def made(seed, count):
    """Words close to each other: random edits of few stems, shuffled stems, and long ones."""
    pick = random.Random(seed)
    letters = "abcdeéÿ×"
    stems = ["".join(pick.choices(letters, k=pick.randint(7, 10))) for _ in range(8)] + ["a" * 30, "ab" * 20, "é" * 300]
    words = {}
    while len(words) < count:
        w = list(pick.choice(stems))
        for _ in range(pick.randint(0, 3)):
            at, kind = pick.randrange(len(w)), pick.randrange(4)
            if kind == 0:
                w[at] = pick.choice(letters)
            elif kind == 1:
                w.insert(at, pick.choice(letters))
            elif kind == 2 and len(w) > 7:
                del w[at]
            else:
                pick.shuffle(w)
        words["".join(w)] = 10 ** pick.randint(0, 4) * 2
    return words


def test_many_leaves_and_parts_lose_no_pair(spark, small_leaves):
    words = made(3, 1500)
    # Words of equal letters fill one box beyond its size.
    pick = random.Random(5)
    while len(words) < 2100:
        words["".join(pick.sample("abcdefgh", 8))] = 5
    frame = spark.createDataFrame(list(words.items()), "word string, n long").repartition(5)
    forest = spelling.fitted(frame)
    assert max(t.leaf.max() for t in forest.trees.values()) > 5 and forest.parts
    assert rows(spelling.variants(frame)) == plain_version(words)


def test_near_pairs_of_one_group():
    for seed in range(5):
        words = list(made(seed, 300))
        for length in {len(w) for w in words}:
            for less in (0, 1):
                a, b = ([w for w in words if len(w) == k] for k in (length, length - less))
                if not a or not b or length - less < 1:
                    continue
                code = [spelling.letters_of([w.encode("latin-1") for w in x], len(x[0])) for x in (a, b)]
                p, q = spelling.near_pairs(*code, within=not less)
                found = [frozenset((a[i], b[j])) for i, j in zip(p.tolist(), q.tolist(), strict=True)]
                assert len(set(found)) == len(found)
                assert set(found) == {frozenset((x, y)) for x in a for y in b if one_edit(x, y)}


@given(st.lists(st.lists(st.integers(0, 3), min_size=4, max_size=4), min_size=1, max_size=60), st.data())
def test_descent_reaches_every_box_within_one_edit(vectors, data):
    counts = np.array(vectors)
    t = spelling.tree(counts, 2)
    home = {r: leaf for leaf, found in spelling.reached(t, counts, 0, 0) for r in found.tolist()}
    assert sorted(home) == list(range(len(counts)))
    for more, fewer in ((1, 1), (1, 0)):
        met = [(leaf, r) for leaf, found in spelling.reached(t, counts, more, fewer) for r in found.tolist()]
        assert len(set(met)) == len(met)
        for i, a in enumerate(counts):
            for j, b in enumerate(counts):
                d = b - a
                if d.clip(0).sum() <= more and (-d).clip(0).sum() <= fewer:
                    assert (home[j], i) in set(met)


def test_nulls_long_texts_repeats_and_clashing_columns(spark):
    text = "colourful Colourful COLOURFUL naïveté's naïveté " * 40 + "colorful colorful x " + "zz" * 60_000
    docs = [(1, text), (1, text), (2, None), (3, ""), (None, "colourfull colourfull"), (4, "ÀÉÎ×÷ÿÿ àéî×÷ÿÿ 123 ÀÉÎ×÷ÿÿ")]
    frame = spark.createDataFrame([(*d, 1, "a", 2) for d in docs], "doc_id long, text string, run int, word string, n int")
    assert rows(spelling.digests(frame)) == plain_version(counted(docs))
    assert spelling.digests(frame.limit(0)).count() == 0


def test_words_as_written(spark):
    frame = spark.createDataFrame([("separate " * 20 + "seperate seperate " + "separated " * 200,)], "text string")
    assert rows(spelling.grouped(frame)) == [
        ("separate", "separated", "separated", 20, 2, 200), ("separated", None, "separated", 200, 1, None),
        ("seperate", "separate", "separated", 2, 1, 20)]
