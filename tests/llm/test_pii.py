import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from tidewatch.llm import pii
from tidewatch.llm.common import table
from tidewatch.llm.pii import digests, find

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else sum(divmod(2 * d, 10))
    return total % 10 == 0


def holds(kind, value):
    digits = re.sub(r"[^0-9]", "", value)
    if kind == "ip":
        return all(int(p) <= 255 for p in value.split("."))
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 9 <= len(digits) <= 15


def spans(text):
    return {k: [m.span() for m in re.finditer(p, text or "") if holds(k, m[0])] for k, p in PATTERNS.items()}


def listed(found):
    return ",".join(f"{k}:{a}:{b}" for k in PATTERNS for a, b in found[k])


def same(rows, out):
    by = {}
    for r in out:
        by.setdefault(r.doc_id, r)
    for doc, text in rows:
        found, r = spans(text), by[doc]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [len(found[k]) for k in PATTERNS]
        assert r.base_sha256 == hashlib.sha256(listed(found).encode()).hexdigest()


def test_given_documents(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    out = digests(docs).collect()
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    same(rows, out)
    texts = dict(rows)
    for r in out:
        for span in filter(None, r.spans.split(",")):
            kind, a, b = span.split(":")
            assert re.search(r"[0-9@]", texts[r.doc_id][int(a):int(b)])


def test_random_texts(spark):
    pick = random.Random(4)
    letters = "aZ._%+-@@..0123456789012345() \né😀"
    rows = [(i, "".join(pick.choices(letters, k=pick.randint(0, 250)))) for i in range(1500)]
    digits = "0123456789 -"
    rows += [(2000 + i, "x".join("".join(pick.choices(digits, k=pick.randint(5, 30))) for _ in range(8))) for i in range(500)]
    rows += [(3000 + i, " ".join(".".join(str(pick.randrange(300)) for _ in range(pick.randint(2, 6))) for _ in range(300)))
             for i in range(5)]
    same(rows, digests(spark.createDataFrame(rows, "doc_id long, text string")).collect())


def test_runs_without_breaks(spark):
    rows = [(1, "a" * 20_000), (2, "1" * 20_000), (3, "1-" * 10_000 + "2"), (4, "a@" * 5_000), (5, "+1 " * 5_000),
            (6, "1.2." * 5_000), (7, "a@b.c_" * 2_000), (8, "4111 1111 1111 1111 x " * 400)]
    same(rows, digests(spark.createDataFrame(rows, "doc_id long, text string").repartition(8)).collect())


def contexts():
    """Documents with seeds behind words of their own, and identifiers that only those words tell."""
    rows = [(i, f"Some text {i}. Call the hotline +1 (555) 555-{1000 + i} or mail to user{i}@mail.example.com today") for i in range(40)]
    rows += [(100 + i, f"Other text. Call the hotline 0555-55{10 + i} now") for i in range(4)]
    rows += [(200 + i, f"Please mail to user{i}(at)example.org at once") for i in range(4)]
    rows += [(300 + i, f"In the year {1900 + i} there were {1000 + i} of them") for i in range(40)]
    return rows


def test_contexts_of_seeds_find_others(spark):
    rows = contexts()
    out = {r.doc_id: r for r in digests(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    same(rows, out.values())
    for doc, text in rows:
        base, every = listed(spans(text)), out[doc].spans
        if 100 <= doc < 104:
            start = text.index("0555")
            assert every == f"phone:{start}:{start + 9}"
        elif 200 <= doc < 204:
            start = text.index("user")
            assert every == f"email:{start}:{start + len(f'user{doc - 200}(at)example.org')}"
        else:
            assert every == base


def test_scores_against_plain(spark):
    docs = spark.createDataFrame(contexts(), "doc_id long, text string")
    found = pii.instances(docs)
    edges = {}
    for r in found.collect():
        edges.setdefault((r.pattern, r.value), r.kind)
    expected = plain_patterns(edges)
    got = {(r.pattern, r.kind): r.score for r in pii.pattern_scores(found).collect()}
    assert got.keys() == expected.keys() and expected
    assert all(got[k] == pytest.approx(expected[k]) for k in got)


def plain_patterns(edges):
    """Accepted patterns of edges (pattern, value) -> seed, all in dictionaries."""
    base, accepted, score, turn = dict(edges), {}, {}, 0
    while True:
        weak = {k: s * n / (n + 2) for k, (s, n) in score.items()}
        now, seeds = {}, {}
        for kind in pii.KINDS:
            best = {}
            for (p, v), seed in edges.items():
                if seed is None:
                    best[v] = max(best.get(v, 0.0), weak.get((p, kind), 0.0))
            for (p, v), seed in edges.items():
                now.setdefault((p, kind), []).append(float(seed == kind) if seed else best[v])
                seeds[p, kind] = seeds.get((p, kind), 0) + (seed == kind)
        score = {k: (sum(x) / len(x), sum(x)) for k, x in now.items()}
        before, turn = len(accepted), turn + 1
        for k, (s, _) in score.items():
            if seeds[k] >= pii.LEAST_INSTANCES and s >= pii.LEAST_SCORE:
                accepted[k] = max(accepted.get(k, 0.0), s)
        if len(accepted) == before and turn >= pii.ROUNDS:
            return accepted
        found = {}
        for (p, v), seed in base.items():
            for kind in pii.KINDS:
                if seed is None and (p, kind) in accepted:
                    found[v] = max(found.get(v, (0.0, "")), (accepted[p, kind], kind))
        edges = {(p, v): seed or (found[v][1] if v in found else None) for (p, v), seed in base.items()}


def test_found_instances_are_seeds_of_the_next_round(spark):
    """Three contexts: one with base seeds, one that shares its found instances only, one that shares those of the second."""
    rows = [(i, f"Text {i}. Please mail to user{i}@mail.example.com today") for i in range(60)]
    rows += [(100 + i, f"Text. Please mail to user{i}(at)example.org today") for i in range(9)]
    rows += [(200 + i, f"Text. You may write towards user{i}(at)example.org too") for i in range(9)]
    rows += [(300 + i, f"Text. You may write towards other{i}(at)example.net too") for i in range(2)]
    rows += [(400 + i, f"Text. Never forget asking user{i}(at)example.org then") for i in range(9)]
    rows += [(500, "Text. Never forget asking last(at)example.net then"), (600, "Text. Unheard of was odd(at)example.net here")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r.doc_id: r for r in digests(docs).collect()}
    same(rows, out.values())
    for doc, text in rows:
        if 100 <= doc < 600:
            assert out[doc].spans == f"email:{text.index(re.search(r'[a-z0-9]+.at.', text)[0])}:{text.index('example') + 11}"
    assert out[600].spans == ""
    found = pii.instances(docs)
    edges = {}
    for r in found.collect():
        edges.setdefault((r.pattern, r.value), r.kind)
    assert {(r.pattern, r.kind) for r in pii.pattern_scores(found).collect()} == set(plain_patterns(edges))


def test_nulls_repeats_extra_columns_and_empty(spark):
    rows = [(1, None, "x"), (2, "", "y"), (3, "a@b.c", "z"), (3, "a@b.c", "z"), (None, "1.2.3.4", "n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, base string")
    out = sorted(((r.doc_id or 0, r.n_email, r.n_ip, r.spans) for r in digests(docs).collect()))
    assert out == [(0, 0, 1, "ip:0:7"), (1, 0, 0, ""), (2, 0, 0, ""), (3, 1, 0, "email:0:5"), (3, 1, 0, "email:0:5")]
    assert find(docs).columns == ["doc_id", "text", "base", "extra"]
    assert digests(docs.limit(0)).count() == 0


def test_no_python_on_the_way(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    plan = digests(docs)._jdf.queryExecution().executedPlan().toString() + pii.instances(docs).where(
        F.lit(True))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
