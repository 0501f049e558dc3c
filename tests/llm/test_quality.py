import zlib

import numpy as np

from tidewatch.llm import quality
from tidewatch.llm.common import stored, table
from tidewatch.llm.quality import described, fit, page_metadata, scored

FOLDER = "/root/testdata/sf0.01"


def test_held_out_rows(spark):
    labels = {r.doc_id: r.quality for r in table(spark, FOLDER, "labels").collect()}
    rows = scored(*(table(spark, FOLDER, n) for n in ("documents", "labels", "pages"))).collect()
    assert len(rows) == 1000
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    held = [(r.predicted, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    assert sum(a == b for a, b in held) / len(held) > 0.95


def test_views_teach_each_other():
    pick = np.random.default_rng(2)
    n = 3000
    truth = (pick.random(n) < 0.5).astype(float)
    # The text view sees three signs of the label, the other view one noisy sign that few labels would show.
    text = truth[:, None] * 2 + pick.normal(size=(n, 3))
    meta = np.c_[truth + pick.normal(size=n) * 0.4, pick.normal(size=(n, 20))]
    model = fit(text[:40], meta[:40], truth[:40], text[40:2000], meta[40:2000])
    alone = fit(text[:40], meta[:40], truth[:40], text[:0], meta[:0]).meta

    def right(logits):
        return ((logits > 0) == (truth[2000:] == 1)).mean()

    assert right(model.meta.logits(meta[2000:])) > right(alone.logits(meta[2000:]))
    assert ((model.scores(text[2000:], meta[2000:]) >= 0.5) == (truth[2000:] == 1)).mean() > 0.95


def test_addresses(spark):
    pages = spark.createDataFrame(
        [(1, "https://a.b/en/7?x=1"), (2, "http://a.b/en/7"), (3, None), (4, "http://a.b/x"), (5, "http://a.b/8.html")],
        "page_id long, url string")
    assert sorted(map(tuple, page_metadata(pages).collect())) == [(7, "http://a.b/en/7"), (8, "http://a.b/8.html")]


def test_nulls_repeats_long_texts_extra_columns_and_empty(spark):
    rows = [(1, None, None, None, 1.0), (None, "", "en", "a", 2.0), (2, "word " * 50_000, "en", "a", 3.0),
            (3, "a b", "en", "a", 4.0), (3, "a b", "en", "a", 4.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, features double")
    pages = spark.createDataFrame([(1, "http://x.y/3")], "page_id long, url string")
    labels = table(spark, FOLDER, "labels")
    assert described(docs, pages).count() == 5
    known = table(spark, FOLDER, "documents")
    model = quality.train(described(known, table(spark, FOLDER, "pages")), labels)
    out = quality.score(described(docs, pages), model).collect()
    assert len(out) == 5 and all(0 <= r.score <= 1 for r in out)
    assert len({r.score for r in out if r.doc_id == 3}) == 1
    assert {r.score for r in scored(docs, labels.limit(0), pages).collect()} == {0.5}
    assert scored(docs.limit(0), labels, pages).count() == 0


def plain_model(text, meta, y, more_text, more_meta):
    """Co-training with sorted lists and whole matrices: rounds by the documented bounds, fits by many small steps."""
    own, more = {"text": text, "meta": meta}, {"text": more_text, "meta": more_meta}
    taught = {v: {} for v in own}
    scale = {v: (x.mean(axis=0), np.where(x.std(axis=0) < 1e-9, 1, x.std(axis=0))) for v, x in own.items()}

    def columns(view, x):
        return np.c_[np.ones(len(x)), (x - scale[view][0]) / scale[view][1]]

    def weights(view, rows):
        at = list(taught[view])
        x = np.r_[columns(view, own[view][rows]), columns(view, more[view][at])]
        t = np.r_[y[rows], [taught[view][i] for i in at]]
        weight = np.r_[np.ones(rows.sum()), np.full(len(at), min(1, len(y) / max(1, len(at))))]
        ridge = np.full(x.shape[1], quality.PENALTY)
        ridge[0] = 1e-6
        beta = np.zeros(x.shape[1])
        for _ in range(40):
            p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
            beta += np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(ridge), x.T @ (weight * (t - p)) - ridge * beta)
        return beta

    every = np.ones(len(y), dtype=bool)
    for _ in range(quality.ROUNDS):
        now = {v: weights(v, every) for v in own}
        new = {v: {} for v in own}
        for giver, to in (("text", "meta"), ("meta", "text")):
            logits = np.clip(columns(giver, more[giver]) @ now[giver], -30, 30)
            for label in (0, 1):
                sure = sorted((int(abs(x) * quality.BINS) for i, x in enumerate(logits)
                               if i not in taught[to] and (x > 0) == label and abs(x) >= np.log(19)), reverse=True)
                most = max(1, quality.SHARE * len(logits) * (y == label).mean())
                fine = [b for b in sure if sum(c >= b for c in sure) <= most]
                least = min(fine) if fine else max(sure, default=None)
                if least is not None:
                    # Bins without rows below the last that fits change nothing.
                    new[to] |= {i: float(label) for i, x in enumerate(logits) if i not in taught[to] and (x > 0) == label
                                and int(abs(x) * quality.BINS) >= least}
        if not any(new.values()):
            break
        for v in own:
            taught[v] |= new[v]
    return {v: weights(v, every) for v in own}, taught


def test_stored_rows_against_the_plain_version(spark):
    docs, labels, pages = (table(spark, FOLDER, n) for n in ("documents", "labels", "pages"))
    views = stored(described(docs, pages), "views").cache()
    model = quality.train(views, labels)
    label = {r.doc_id: float(r.quality > 0) for r in labels.collect() if r.quality is not None and zlib.crc32(str(r.doc_id).encode()) % 5}
    rows = sorted((r.doc_id, r.features, r.meta) for r in views.collect())
    known = [r for r in rows if r[0] in label]
    free = [r for r in rows if r[0] not in label and zlib.crc32(str(r[0]).encode()) % 5]
    assert len(free) > 300

    def matrices(rows):
        meta = np.zeros((len(rows), quality.META_COLUMNS))
        for i, (_, _, values) in enumerate(rows):
            meta[i, [zlib.crc32(v.encode()) % quality.META_COLUMNS for v in values]] = 1
        return np.array([f for _, f, _ in rows]), meta

    expected, taught = plain_model(*matrices(known), np.array([label[r[0]] for r in known]), *matrices(free))
    assert all(taught.values())
    assert np.allclose(model.text.weights, expected["text"], atol=1e-3)
    assert np.allclose(model.meta.weights, expected["meta"], atol=1e-3)


def test_every_unlabelled_row_takes_part(spark):
    """Documents of one source loaded last, and very long ones, get labels too, in memory as in Spark."""
    pick = np.random.default_rng(4)
    truth = (pick.random(900) < 0.5).astype(float)
    text, meta = truth[:, None] * 3 + pick.normal(size=(900, 2)), np.zeros((900, quality.META_COLUMNS))
    meta[np.arange(900), pick.integers(0, 3, 900) + 3 * truth.astype(int)] = 1
    frame = spark.createDataFrame([(t.tolist(), [int(x) for x in np.flatnonzero(m)]) for t, m in zip(text[60:], meta[60:], strict=True)],
                                  "features array<double>, hashed array<int>").repartition(4)
    rows, kept = quality.Rows(text[60:], meta[60:]), quality.StoredRows(stored(frame, "rows"))
    a, b = (quality.cotrain(text[:60], meta[:60], truth[:60], x) for x in (rows, kept))
    assert np.allclose(a.text.weights, b.text.weights) and np.allclose(a.combined, b.combined)
    at = rows.taught["meta"][0]
    assert len(at) > 100 and at.max() > 800


def test_repeated_and_one_sided_labels(spark):
    docs = spark.createDataFrame([(i, "text words here " * (1 + i % 3), "en", "s") for i in range(40)] * 3,
                                 "doc_id long, text string, lang string, source string")
    pages = spark.createDataFrame([], "page_id long, url string")
    views = stored(described(docs, pages), "views")
    one = spark.createDataFrame([(i, 1) for i in range(40)], "doc_id long, quality int")
    assert quality.train(views, one) is None
    both = spark.createDataFrame([(i, i % 2) for i in range(20)] * 2 + [(None, 1), (99, 0)], "doc_id long, quality int")
    model = quality.train(views, both)
    assert len(model.text.weights) == len(quality.text_features("")) + 1
