import random

import pytest
from pyspark.sql import functions as F

from tidewatch.llm.topk import search, sign_codes


def plain(codes, queries, k):
    def apart(a, b):
        return sum((x ^ y).bit_count() for x, y in zip(a, b, strict=True))

    out = []
    for q, code in queries:
        near = sorted({(apart(code, c), i) for i, c in codes if c is not None and i != q})[:k] if code is not None else []
        out += [(q, n, i, d) for n, (d, i) in enumerate(near, 1)]
    return sorted(out)


def run(spark, codes, queries, k):
    a = spark.createDataFrame(codes, "id long, code array<int>").repartition(3)
    b = spark.createDataFrame(queries, "query_id long, code array<int>")
    return sorted((r.query_id, r.rank, r.id, r.distance) for r in search(a, b, k).collect())


@pytest.mark.parametrize("bits", [4, 30])
def test_against_all_pairs(spark, bits):
    pick = random.Random(bits)
    codes = [(i, [pick.getrandbits(16) & pick.getrandbits(16) & ((1 << bits) - 1) for _ in range(2)]) for i in range(300)]
    queries = codes[::30]
    assert run(spark, codes, queries, 5) == plain(codes, queries, 5)


def test_one_code_of_many_rows_ties_and_few_rows(spark):
    codes = [(i, [7, 7]) for i in range(500)] + [(1000 + i, [7, 1 << i]) for i in range(16)] + [(5000, None)]
    queries = [(3, [7, 7]), (499, [7, 7]), (1003, [7, 8]), (9999, [65535, 0]), (5000, None)]
    assert run(spark, codes, queries, 4) == plain(codes, queries, 4)
    assert run(spark, codes[:3], queries, 4) == plain(codes[:3], queries, 4)
    assert run(spark, codes[:3] * 2, queries, 4) == plain(codes[:3], queries, 4)


def test_codes_of_vectors(spark):
    rows = [(1, [0.5, -1.0, None, 2.0]), (2, None), (3, [1.0]), (4, [])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("code", F.lit("x"))
    assert {r.id: r.code for r in sign_codes(vectors).collect()} == {1: [9], 2: None, 3: [1], 4: [0]}
    assert sign_codes(vectors.limit(0)).count() == 0
    empty = sign_codes(vectors.limit(0))
    assert search(empty, empty.withColumnRenamed("id", "query_id"), 3).count() == 0
