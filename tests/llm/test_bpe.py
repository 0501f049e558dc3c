import hashlib
import json
import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidewatch.llm import bpe
from tidewatch.llm.bpe import Merges

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def merges():
    with open(PATH, "rb") as file:
        return Merges(json.loads(file.read()))


@pytest.fixture(scope="module")
def library():
    tokenizer = Tokenizer.from_file(PATH)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def same(merges, library, texts):
    expected = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    got = merges.encode(texts)
    assert [np.frombuffer(x, dtype="<u4").tolist() for x in got] == expected
    assert [merges.decode(x) for x in got] == library.decode_batch(expected, skip_special_tokens=False)


def test_every_kind_of_character(merges, library):
    points = [*range(1, 0x3000), *range(0x3000, 0xD800, 37), *range(0xE000, 0x110000, 301)]
    same(merges, library, [f"a {chr(c)}b1{chr(c) * 2} {chr(c)}" for c in points])


def test_random_texts_and_runs(merges, library):
    pick = random.Random(5)
    letters = "aaabcdeehiilnoorstt   \n\t'.,!?-=_019éüñ中😀\x85\x1c\x00"
    same(merges, library, ["".join(pick.choices(letters, k=pick.randint(0, 300))) for _ in range(2000)])
    same(merges, library, [pick.choice("a -=0é") * pick.randint(0, 900) + "the" for _ in range(300)])
    pieces = [b.decode("utf-8", "ignore") for b in merges.bytes]
    same(merges, library, ["".join(pick.choices(pieces, k=40)) for _ in range(2000)])


def test_strings_of_added_tokens(merges, library):
    same(merges, library, ["<|endoftext|>", "x<|endoftext|>y <|endoftext|><|endoftext|> z", "<|endoftext", ""])


def test_speculation_meets_exact_merging(merges):
    pick = random.Random(6)
    words = list({"".join(pick.choices("abcdehilnorstu", k=pick.randint(1, 90))) for _ in range(3000)})
    cuts = merges.cut(words)
    for word in words:
        raw = word.encode()
        single = [merges.byte_id[b] for b in raw]
        assert np.frombuffer(cuts[word], dtype="<u4").tolist() == merges._merged_long(single) == merges.merged(raw)


def test_forgetting_words_changes_nothing(merges, library, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBER_BYTES", 5_000)
    pick = random.Random(7)
    for _ in range(5):
        same(merges, library, [" ".join("".join(pick.choices("abcdet", k=pick.randint(1, 99))) for _ in range(60))])
        assert merges.known_bytes == sum(len(w) + len(x) + bpe._WORD_BYTES for w, x in merges.known.items())


def test_unknown_ids_and_broken_utf8(merges, library):
    ids = [220, 447, 50256, 222, 999_999]
    with open(PATH, "rb") as file:
        pieces = bpe.Pieces(json.loads(file.read()))
    assert pieces.bytes == merges.bytes and pieces.size == merges.size
    assert merges.decode(np.array(ids, dtype="<u4").tobytes()) == library.decode(ids[:4], skip_special_tokens=False)


def test_columns_nulls_repeats_and_long_texts(spark, library):
    long = "word, " * 50_000
    rows = [(1, None, "x"), (2, "", "y"), (3, "Hello world", "z"), (3, "Hello world", "z"), (4, long, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    out = {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.digests(docs, PATH).collect()}
    expected = set()
    for key, text, _ in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        packed = np.array(ids, dtype="<u4").tobytes()
        expected.add((key, len(ids), hashlib.sha256(packed).hexdigest(),
                      hashlib.sha256((text or "").encode()).hexdigest()))
    assert out == expected
    assert bpe.digests(docs, PATH).count() == 5
    back = bpe.decode(bpe.encode(docs.select("doc_id", "text"), PATH), PATH, text="again")
    assert back.where(~F.col("again").eqNullSafe(F.coalesce("text", F.lit("")))).count() == 0
    assert bpe.digests(docs.limit(0), PATH).count() == 0
