import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm import brute
from tests.llm.test_lines import plain
from tidewatch.llm import mixing, toxicity
from tidewatch.llm.common import stored, table

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark):
    """What goes in, and what each stage gives."""
    docs = [table(spark, FOLDER, "documents")]
    for name, stage in corpus_pipeline.STAGES:
        docs.append(stored(stage(spark, docs[-1], FOLDER), name))
    return docs


def test_stages_keep_the_columns(stages):
    assert all(d.columns == stages[0].columns for d in stages[1:-1])


def test_toxicity_rejects_what_scores_as_toxic(stages, spark):
    labels = table(spark, FOLDER, "labels")
    scores = {r.doc_id: r.predicted for r in toxicity.scored(stages[0], labels).collect()}
    assert {r.doc_id for r in stages[1].collect()} == {d for d, p in scores.items() if not p}
    clean = {r.doc_id for r in labels.where("toxic = 0").collect()}
    kept = {r.doc_id for r in stages[1].collect()}
    assert len(clean & kept) >= 0.99 * len(clean)


def test_shared_lines_go(stages):
    rows = [(r.doc_id, r.text) for r in stages[1].collect()]
    expected = {d: t for d, t, _, _ in plain(rows, 10)}
    assert {r.doc_id: (r.text, r.n_chars) for r in stages[2].collect()} == {d: (t, len(t)) for d, t in expected.items()}


def test_one_of_each_group_stays(stages):
    components = brute.components(brute.shingle_sets([(r.doc_id, r.text) for r in stages[2].collect()]), 80)
    assert sorted(r.doc_id for r in stages[3].collect()) == sorted(set(components.values()))


def test_the_sample_is_the_one_of_the_probabilities(stages):
    chosen = mixing.probabilities(stages[3]).where("sampled").select("doc_id")
    assert sorted(r.doc_id for r in stages[4].collect()) == sorted(r.doc_id for r in chosen.collect())


def test_ids_are_those_of_the_library(stages):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for r in stages[5].collect():
        expected = tokenizer.encode(r.text, add_special_tokens=False).ids
        assert np.frombuffer(bytes(r.ids), dtype="<u4").tolist() == expected and r.n_tokens == len(expected)


def test_nulls_and_empty_tables_pass(spark, stages):
    docs = stages[0].limit(40).unionByName(stages[0].limit(1).select(
        *(F.lit(None).cast(f.dataType).alias(f.name) for f in stages[0].schema)))
    for some in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            some = stage(spark, some, FOLDER)
            some.count()


def test_near_duplicates_are_linked_at_four_fifths(spark, stages):
    # 100 shingles each: 91 common of 109 is 0.8348, 89 common of 111 is 0.8018, 88 common of 112 is 0.7857.
    a = [f"a{i}" for i in range(104)]
    texts = [a, a[:95] + [f"x{i}" for i in range(9)], a[11:] + [f"y{i}" for i in range(11)],
             [f"z{i}" for i in range(12)] + a[:92]]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    for some in (docs, stages[2]):
        expected = brute.components(brute.shingle_sets([(r.doc_id, r.text) for r in some.collect()]), 80)
        out = corpus_pipeline.without_near_duplicates(spark, some, FOLDER)
        assert sorted(r.doc_id for r in out.collect()) == sorted(set(expected.values()))


def test_columns_of_the_caller_survive(spark, stages):
    own = ("n_lines", "n_dropped", "mix_topic", "probability", "Sampled", "score", "spans", "ids", "n_tokens", "topic", "label", "_gone")
    docs = stages[0].limit(60).select("*", *(F.concat(F.lit(f"{c} "), F.col("doc_id")).alias(c) for c in own))
    docs = docs.unionByName(docs.limit(5)).unionByName(docs.limit(1).select(
        *(F.lit(None).cast(f.dataType).alias(f.name) for f in docs.schema)))
    for name, stage in corpus_pipeline.STAGES:
        out = stored(stage(spark, docs, FOLDER), name)
        assert out.columns[:len(docs.columns)] == docs.columns
        broken = out.where(" OR ".join(f"NOT (`{c}` <=> '{c} ' || doc_id)" for c in own))
        assert broken.count() == 0
        docs = out
    assert docs.columns[-2:] == ["ids_", "n_tokens_"] and docs.where("octet_length(ids_) <> 4 * n_tokens_").count() == 0
