import itertools

import pytest
from pyspark.sql import functions as F

from tidewatch.llm import mixing
from tidewatch.llm.common import table
from tidewatch.llm.mixing import cell_weights, probabilities, sample

FOLDER = "/root/testdata/sf0.001"


def shares(rows, of, weight):
    total, out = sum(weight(r) for r in rows), {}
    for r in rows:
        out[r[of]] = out.get(r[of], 0) + weight(r) / total
    return out


def test_marginals_meet_tempered_targets(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    rows = mixing.digests(docs).collect()
    for of in ("source", "lang", "topic"):
        tempered = {k: v**mixing.TEMPER for k, v in shares(rows, of, lambda r: r.n_tokens).items()}
        got = shares(rows, of, lambda r: r.n_tokens * r.probability)
        for k, v in tempered.items():
            assert got[k] == pytest.approx(v / sum(tempered.values()), abs=1e-5)
    assert max(r.probability for r in rows) == 1.0


def test_given_targets(spark):
    cells = [(s, l, t, 10 + 7 * i) for i, (s, l, t) in enumerate(itertools.product("ab", ("en", "de"), "xy"))]
    cells.append(("c", "en", "x", 0))
    cells = spark.createDataFrame(cells, "source string, lang string, topic string, tokens long")
    out = cell_weights(cells, {"source": {"a": 3.0, "b": 1.0, "unknown": 9.0}}, rounds=60).collect()
    assert shares(out, "source", lambda r: r.tokens * r.weight)["a"] == pytest.approx(0.75, abs=1e-6)
    assert [r.weight for r in out if r.source == "c"][0] > 0


def test_sampling_follows_the_probabilities(spark):
    docs = spark.range(20_000).select(
        F.col("id").alias("doc_id"), F.lit("some text here").alias("text"), F.lit("en").alias("lang"),
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), (F.col("id") % 7).cast("string"))).alias("source"))
    out = probabilities(docs)
    for r in out.groupBy("source").agg(F.avg("probability").alias("p"), F.avg(F.col("sampled").cast("int")).alias("s")).collect():
        assert r.s == pytest.approx(r.p, abs=0.03)
    assert sample(docs).columns == docs.columns


def test_nulls_repeats_extra_columns_and_empty(spark):
    rows = [(1, None, None, None, 1), (2, "", "en", "a", 2), (3, "text", None, "a", 3), (3, "text", None, "a", 3),
            (None, "more text", "en", None, 4), (5, "long " * 50_000, "en", "a", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, probability int")
    out = probabilities(docs)
    assert out.columns == ["doc_id", "text", "lang", "source", "mix_topic", "probability", "sampled"]
    found = out.collect()
    assert len(found) == 6 and all(0 < r.probability <= 1 for r in found)
    assert len({(r.probability, r.sampled) for r in found if r.doc_id == 3}) == 1
    assert probabilities(docs.limit(0)).count() == 0
    assert sample(docs.limit(0)).columns == docs.columns
    blank = docs.where("doc_id <= 2")
    assert probabilities(blank).count() == 2


def test_no_python_on_the_way(spark):
    plan = mixing.digests(table(spark, FOLDER, "documents"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan
