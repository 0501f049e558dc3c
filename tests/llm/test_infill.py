import hashlib
import re

import pytest
from hypothesis import given
from hypothesis import strategies as st

from tidewatch.llm import infill
from tests.conftest import rows

UNIT = re.compile(r"[ \t-\r]*[^ \t-\r]+|[ \t-\r]+")


def plain_version(doc, text, seed=42):
    """The contract step by step, units listed one after another."""
    text = text or ""
    d = hashlib.sha256(f"{seed}:{'' if doc is None else doc}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(d[8 * i:8 * i + 8], 16) for i in range(4))
    units = UNIT.findall(text)
    n = len(units)
    i, j = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b, c = ("".join(x) for x in (units[:i], units[i:j], units[j:]))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return n, "plain", None, None, text
    if h4 % 100 < 80:
        return n, "spm", len(a), len(b), f"<S>{c}<P>{a}<M>{b}"
    return n, "psm", len(a), len(b), f"<P>{a}<S>{c}<M>{b}"


@given(st.text(alphabet=" \t\n  aé😀<PSM>", max_size=40), st.integers(0, 400))
def test_texts_against_the_plain_version(text, doc):
    d = hashlib.sha256(f"42:{doc}".encode()).hexdigest()
    h = [int(d[8 * i:8 * i + 8], 16) for i in range(4)]
    assert infill.infilled(text, *h) == plain_version(doc, text)


CASES = [
    *((i, "  one two\n\nthrée 😀 four  five  " * (1 + i % 3)) for i in range(60)),
    *((i, f"<{'<' * (i % 3)} S> <P M> {i} <S") for i in range(60, 90)),
    (90, None), (91, ""), (92, " \t\n"), (93, "a <M> b"), (None, "no id here"), (94, "x"),
    (95, "word " * 200_000), (96, " " * 100_000), (97, "y" * 300_000), (94, "x"), (0, "one id, another text"),
]


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame([(*c, "kept", 7) for c in CASES], "doc_id long, text string, form string, extra int")


def test_rows_against_the_plain_version(table):
    found = infill.transform(table)
    assert found.columns == ["doc_id", "text", "extra", "n", "form", "prefix_chars", "middle_chars", "output"]
    assert rows(found) == sorted(((d, t, 7, *plain_version(d, t)) for d, t in CASES), key=repr)
    assert {r.form for r in found.collect()} == {"plain", "psm", "spm"}


def test_texts_come_back_from_output_and_form(table):
    back = infill.restore(infill.transform(table).select("doc_id", "output", "form"), text="back")
    assert sorted((r.doc_id or -1, r.back) for r in back.collect()) == sorted((d or -1, t or "") for d, t in CASES)


def test_digests(table):
    def sha(x):
        return hashlib.sha256(x.encode()).hexdigest()

    expected = []
    for d, t in CASES:
        *head, out = plain_version(d, t)
        expected.append((d, *head, sha(out), sha(t or "")))
    assert rows(infill.digests(table)) == sorted(expected, key=repr)


def test_empty_table_and_seed(spark, table):
    assert infill.digests(table.limit(0)).count() == 0
    other = infill.transform(table.where("doc_id = 1"), seed=7).first()
    assert tuple(other)[3:] == plain_version(1, CASES[1][1], seed=7)
