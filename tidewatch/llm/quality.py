"""Document quality by co-training two views.

One classifier sees the text, the other what is known about the document and the page it stands on. In rounds each
labels the unlabelled documents it is most sure of, and these teach the other. Calibrated logits of both are combined.

Only labelled rows are a bounded sample. All other documents take part in every round: they are scored where they are
stored, a histogram of how sure each view is gives the bounds, and both classifiers are fitted from summed gradients.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import ship, stored, text_of
from tidewatch.session import new_table_path

# The bounded sample of labelled documents, by a hash of the id.
LABELLED = 4000
# Rounds of exchange; a round hands over about this share of the unlabelled documents, if the view is this sure. What a
# view was given weighs as much as the labelled documents together, at most.
ROUNDS, SHARE, SURE = 5, 0.05, 0.95
# Passes of a fit at most, the change of a weight that ends it, and the penalty on weights.
STEPS, LEAST_STEP, PENALTY = 12, 1e-4, 1.0
# How sure a view is, is told apart in steps of a logit as small as this, up to the largest logit.
BINS, MOST_LOGIT = 100, 30
# Metadata values are hashed into so many columns.
META_COLUMNS = 128
THRESHOLD = 0.5

_CLASSES = (b"#$%&*|<>{}[]=_~^\\/", b"!?", b".,;:", b"0123456789", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_SENTENCE = re.compile(r"[.!?\n]+")


def text_features(text: str) -> list[float]:
    """What the text looks like: kinds of characters, words, repetition; with squares. Empty texts have zeros."""
    raw = text.encode()
    counts = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256)
    n, words = max(1, len(raw)), text.split()
    kinds = [float(sum(counts[b] for b in kind)) / n for kind in _CLASSES]
    many, seen = max(1, len(words)), Counter(words)
    lines = text.split("\n")
    pairs = Counter(zip(words, words[1:], strict=False))
    out = [
        *kinds, np.log1p(len(words)) / 10, len(seen) / many, (seen.most_common(1)[0][1] / many) if seen else 0.0,
        sum(map(len, words)) / many / 10, len(set(lines)) / len(lines), min(1.0, len(_SENTENCE.split(text)) / many),
        (pairs.most_common(1)[0][1] / many) if pairs else 0.0, sum(a == b for a, b in zip(words, words[1:], strict=False)) / many,
        counts[128:].sum() / n,
    ]
    return [*out, *(x * x for x in out)]


VIEWS = ("text", "meta")
OTHER = {"text": "meta", "meta": "text"}


class View(NamedTuple):
    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray

    @staticmethod
    def scaled(x: np.ndarray) -> View:
        """A view without weights that scales as these rows need."""
        spread = x.std(axis=0)
        spread[spread < 1e-9] = 1.0
        return View(x.mean(axis=0), spread, np.zeros(x.shape[1] + 1))

    def columns(self, x: np.ndarray) -> np.ndarray:
        """A constant and the scaled values."""
        return np.c_[np.ones(len(x)), (x - self.mean) / self.spread]

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self.columns(x) @ self.weights, -MOST_LOGIT, MOST_LOGIT)


class Model(NamedTuple):
    """Both views, and the constant and weights of their logits."""

    text: View
    meta: View
    combined: np.ndarray

    def scores(self, text: np.ndarray, meta: np.ndarray) -> np.ndarray:
        x = np.c_[np.ones(len(text)), self.text.logits(text), self.meta.logits(meta)]
        return 1 / (1 + np.exp(-np.clip(x @ self.combined, -30, 30)))


def _logistic(x: np.ndarray, y: np.ndarray, penalty: float) -> np.ndarray:
    """Weights by Newton's method; the constant, in the first column, is not penalised."""
    beta, ridge = np.zeros(x.shape[1]), penalty * np.eye(x.shape[1])
    ridge[0, 0] = 1e-6
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (y - p) - ridge @ beta)
        beta += step
        if np.abs(step).max() < 1e-6:
            break
    return beta


class Round(NamedTuple):
    """Both views after a round, and by (view, label) the bin of certainty from which the view labels a document."""

    views: dict[str, View]
    least: dict[tuple[str, int], float]


def _certainty(logits: np.ndarray) -> np.ndarray:
    return np.floor(np.abs(logits) * BINS).astype(np.int64)


def given(rows: dict[str, np.ndarray], rounds: list[Round]) -> dict[str, np.ndarray]:
    """Per view the label that the other one gave each row in the first round it was sure enough, else -1."""
    out = {v: np.full(len(rows[v]), -1) for v in VIEWS}
    for r in rounds:
        for view in VIEWS:
            logits = r.views[OTHER[view]].logits(rows[OTHER[view]])
            bins, label = _certainty(logits), (logits > 0).astype(int)
            least = np.where(label == 1, r.least[OTHER[view], 1], r.least[OTHER[view], 0])
            out[view] = np.where((out[view] < 0) & (bins >= least), label, out[view])
    return out


_BINS = MOST_LOGIT * BINS + 1


def certainties(rows: dict[str, np.ndarray], rounds: list[Round], now: dict[str, View]) -> np.ndarray:
    """How many rows each view would label how, by view, label and bin; rows that the other was given before don't count."""
    before, out = given(rows, rounds), np.zeros((2, 2, _BINS), dtype=np.int64)
    for i, view in enumerate(VIEWS):
        logits = now[view].logits(rows[view])
        bins = _certainty(logits)
        free = (before[OTHER[view]] < 0) & (bins >= np.log(SURE / (1 - SURE)) * BINS)
        np.add.at(out[i], ((logits[free] > 0).astype(int), bins[free]), 1)
    return out


def _least(counts: np.ndarray, most: float) -> float:
    """The smallest bin whose rows and all surer ones are at most so many; rows of the top bin in any case."""
    above = np.cumsum(counts[::-1])[::-1]
    if not above[0]:
        return np.inf
    return min(int(np.flatnonzero(counts)[-1]), int(np.argmax(above <= most)) if (above <= most).any() else _BINS)


def slopes(view: View, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Log likelihood of these rows, its gradient and curvature, flat."""
    columns = view.columns(x)
    odds = columns @ view.weights
    p = 1 / (1 + np.exp(-np.clip(odds, -MOST_LOGIT, MOST_LOGIT)))
    value = (y * odds - np.logaddexp(0, odds)).sum()
    return np.concatenate([[value], columns.T @ (y - p), ((columns * (p * (1 - p))[:, None]).T @ columns).ravel()])


class Rows:
    """Unlabelled rows in memory: what ``cotrain`` asks of them."""

    def __init__(self, text: np.ndarray, meta: np.ndarray):
        self.rows, self.count = {"text": text, "meta": meta}, len(text)
        self.taught = {v: (np.zeros(0, dtype=int), np.zeros(0)) for v in VIEWS}

    def certainties(self, rounds: list[Round], now: dict[str, View]) -> np.ndarray:
        return certainties(self.rows, rounds, now)

    def hand_over(self, rounds: list[Round]) -> None:
        labels = given(self.rows, rounds)
        self.taught = {v: (np.flatnonzero(labels[v] >= 0), labels[v][labels[v] >= 0].astype(float)) for v in VIEWS}

    def slopes(self, learners: list[tuple[str, View]]) -> list[np.ndarray]:
        return [slopes(view, self.rows[v][self.taught[v][0]], self.taught[v][1]) for v, view in learners]


class _Climb:
    """Newton's method for one view: the best weights so far, and the step tried from them, halved where it was too far."""

    def __init__(self, view: View):
        self.best = self.tried = view
        self.value, self.step, self.done = -np.inf, np.zeros(len(view.weights)), False

    def told(self, total: np.ndarray) -> None:
        """Take the value, gradient and curvature at the weights that were tried."""
        size = len(self.step)
        ridge = np.full(size, PENALTY)
        ridge[0] = 1e-6
        weights = self.tried.weights
        value = total[0] - 0.5 * (ridge * weights * weights).sum()
        if value >= self.value - 1e-9 * abs(self.value):
            self.best, self.value = self.tried, value
            self.step = np.linalg.solve(total[1 + size:].reshape(size, size) + np.diag(ridge), total[1:1 + size] - ridge * weights)
        else:
            self.step = self.step / 2
        self.done = np.abs(self.step).max() < LEAST_STEP
        self.tried = self.best._replace(weights=self.best.weights + self.step)


def _fit(learners: list[tuple[str, View, np.ndarray, np.ndarray]], unlabelled, factor: dict[str, float]) -> list[View]:
    """Views fitted to labelled rows (values, labels) and to what each was given, all of them in one pass a step."""
    climbs = [_Climb(view) for _, view, _, _ in learners]
    for _ in range(STEPS):
        open_ = [(c, *learner) for c, learner in zip(climbs, learners, strict=True) if not c.done]
        if not open_:
            break
        taught = unlabelled.slopes([(v, c.tried) for c, v, *_ in open_])
        for (c, v, _, x, y), more in zip(open_, taught, strict=True):
            c.told(slopes(c.tried, x, y) + factor[v] * more)
    return [c.best for c in climbs]


def _folds(n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    fold = np.arange(n) % 3
    return [(fold != i, fold == i) for i in range(3)]


def cotrain(text: np.ndarray, meta: np.ndarray, y: np.ndarray, unlabelled) -> Model | None:
    """The model of labelled rows and of ``unlabelled`` ones (``Rows`` or the like).

    None where one label has under three rows. Every unlabelled row may be labelled in every round.
    """
    if min((y == 1).sum(), (y == 0).sum()) < 3:
        return None
    own, rounds = {"text": text, "meta": meta}, []
    now, number = {v: View.scaled(own[v]) for v in VIEWS}, dict.fromkeys(VIEWS, 0)

    def factor() -> dict[str, float]:
        return {v: min(1.0, len(y) / number[v]) if number[v] else 0.0 for v in VIEWS}

    def refitted() -> dict[str, View]:
        return dict(zip(VIEWS, _fit([(v, now[v], own[v], y) for v in VIEWS], unlabelled, factor()), strict=True))

    now = refitted()
    for _ in range(ROUNDS if unlabelled.count else 0):
        counts, least = unlabelled.certainties(rounds, now), {}
        for i, view in enumerate(VIEWS):
            for label in (0, 1):
                # As many of each label as there are among the labelled rows.
                most = max(1.0, SHARE * unlabelled.count * (y == label).mean())
                least[view, label] = _least(counts[i, label], most)
                if least[view, label] < np.inf:
                    number[OTHER[view]] += int(counts[i, label, int(least[view, label]):].sum())
        if min(least.values()) == np.inf:
            break
        rounds.append(Round(now, least))
        unlabelled.hand_over(rounds)
        now = refitted()
    # Logits of rows that a view wasn't fitted on show how far each can be trusted.
    held = np.zeros((len(y), 2))
    folds = [(fitted, rest) for fitted, rest in _folds(len(y)) if len(set(y[fitted].tolist())) == 2]
    parts = [(i, v, fitted, rest) for fitted, rest in folds for i, v in enumerate(VIEWS)]
    fits = _fit([(v, now[v], own[v][fitted], y[fitted]) for _, v, fitted, _ in parts], unlabelled, factor())
    for (i, v, _, rest), view in zip(parts, fits, strict=True):
        held[rest, i] = view.logits(own[v][rest])
    return Model(now["text"], now["meta"], _logistic(np.c_[np.ones(len(y)), held], y, 1.0))


def fit(text: np.ndarray, meta: np.ndarray, y: np.ndarray, more_text: np.ndarray, more_meta: np.ndarray) -> Model | None:
    """The model of labelled rows (first three) and unlabelled ones, all in memory."""
    return cotrain(text, meta, y, Rows(more_text, more_meta))


def _matrices(features: pa.Array, hashed: pa.Array) -> dict[str, np.ndarray]:
    """Both views of the rows of a batch."""
    n = len(features)
    text = features.flatten().to_numpy(zero_copy_only=False).reshape(n, -1)
    meta = np.zeros((n, META_COLUMNS))
    meta[np.repeat(np.arange(n), hashed.value_lengths().to_numpy(zero_copy_only=False)),
         hashed.flatten().to_numpy(zero_copy_only=False)] = 1.0
    return {"text": text, "meta": meta}


class StoredRows:
    """Unlabelled rows of a stored table with ``features`` and ``hashed``. Each answer is an aggregate over all of them."""

    def __init__(self, rows: DataFrame):
        self.rows, self.spark, self.count = rows.select("features", "hashed"), rows.sparkSession, rows.count()
        self.parts: list[str] = []

    def _summed(self, rows: DataFrame, values: Callable[[pa.RecordBatch], np.ndarray], size: int) -> np.ndarray:
        """The sum of a vector over the batches of all tasks: summed per task, then by its places, so that the driver
        gets one vector however many tasks there are."""

        def per_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(size)
            for batch in batches:
                if batch.num_rows:
                    total += values(batch)
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_pydict({"place": at.astype(np.int64), "value": total[at]})

        out = np.zeros(size)
        for r in rows.mapInArrow(per_task, "place long, value double").groupBy("place").agg(F.sum("value").alias("value")).collect():
            out[r.place] = r.value
        return out

    def certainties(self, rounds: list[Round], now: dict[str, View]) -> np.ndarray:
        sent = self.spark.sparkContext.broadcast((rounds, now))

        def counted(batch: pa.RecordBatch) -> np.ndarray:
            return certainties(_matrices(batch.column(0), batch.column(1)), *sent.value).ravel()

        return self._summed(self.rows, counted, 4 * _BINS).reshape(2, 2, _BINS).astype(np.int64)

    def hand_over(self, rounds: list[Round]) -> None:
        """Store the rows that the last round labelled: passes over what was given don't read the others."""
        sent = self.spark.sparkContext.broadcast(rounds)

        def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = _matrices(batch.column(0), batch.column(1))
                before, after = given(rows, sent.value[:-1]), given(rows, sent.value)
                for view in VIEWS:
                    new = (before[view] < 0) & (after[view] >= 0)
                    picked = batch.filter(pa.array(new))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([view] * picked.num_rows, pa.string()), pa.array(after[view][new], pa.int64()), *picked.columns],
                        names=["view", "label", "features", "hashed"])

        path = new_table_path(self.spark, "quality_given")
        self.rows.mapInArrow(chosen, "view string, label long, features array<double>, hashed array<int>").write.parquet(path)
        self.parts.append(path)

    def slopes(self, learners: list[tuple[str, View]]) -> list[np.ndarray]:
        sizes = [1 + len(view.weights) * (len(view.weights) + 1) for _, view in learners]
        if not self.parts:
            return [np.zeros(n) for n in sizes]
        sent = self.spark.sparkContext.broadcast(learners)

        def summed(batch: pa.RecordBatch) -> np.ndarray:
            of, label = np.array(batch.column(0).to_pylist()), batch.column(1).to_numpy(zero_copy_only=False).astype(float)
            rows = _matrices(batch.column(2), batch.column(3))
            return np.concatenate([slopes(view, rows[v][of == v], label[of == v]) for v, view in sent.value])

        taught = self.spark.read.schema("view string, label long, features array<double>, hashed array<int>").parquet(*self.parts)
        return np.split(self._summed(taught, summed, sum(sizes)), np.cumsum(sizes)[:-1])


def page_metadata(pages: DataFrame) -> DataFrame:
    """(doc_id, url) of the pages whose address ends in a document's number; of several the smallest address."""
    number = F.regexp_extract("url", r"/([0-9]{1,18})(?:[/.?#]|$)", 1)
    return pages.select(F.when(number != "", number.cast("long")).alias("doc_id"), "url").where(
        F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("url").alias("url"))


def described(docs: DataFrame, pages: DataFrame) -> DataFrame:
    """``doc_id`` with both views of each document: ``features`` of the whole text, and ``meta``, metadata as texts.

    Metadata are source, language, length, and parts of the address of the document's page; ``hashed`` are the columns
    they fall in. Features are computed where the text is read, in one pass over texts of any length, so no text is
    shuffled. NULL texts are read as empty, NULL metadata are empty; a NULL id has no page. Repeated rows are described
    one by one, an empty table stays empty. Other columns of the caller are left out, whatever their names.
    """
    ship(docs.sparkSession)

    @F.pandas_udf("array<double>")
    def features(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([text_features(t) for t in texts], dtype=object)

    urls = page_metadata(pages).withColumnRenamed("doc_id", "_page")
    rows = docs.select("doc_id", "source", "lang", F.length(text_of("text")).alias("n"),
                       features(text_of("text")).alias("features"))
    joined = rows.join(urls, F.col("doc_id") == F.col("_page"), "left").withColumn("url", F.coalesce("url", F.lit("")))
    size = F.floor(F.log2(F.greatest("n", F.lit(1)))).cast("string")
    host = F.regexp_extract("url", r"^[a-z]+://([^/?#]+)", 1)
    meta = F.concat(
        F.array(F.concat(F.lit("s="), F.coalesce("source", F.lit(""))), F.concat(F.lit("l="), F.coalesce("lang", F.lit(""))),
                F.concat(F.lit("n="), size), F.concat(F.lit("https="), F.col("url").startswith("https").cast("string")),
                F.concat(F.lit("query="), F.col("url").contains("?").cast("string"))),
        F.transform(F.filter(F.split(host, r"[.-]"), lambda w: w != ""), lambda w: F.concat(F.lit("h="), w)))
    hashed = F.array_distinct(F.transform("meta", lambda x: (F.crc32(x.cast("binary")) % META_COLUMNS).cast("int")))
    return joined.select("doc_id", "n", "features", meta.alias("meta")).select("*", hashed.alias("hashed"))


def held_out(doc_id):
    """Rows whose labels are never learned from; a NULL id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def train(views: DataFrame, labels: DataFrame) -> Model | None:
    """The model of ``described`` documents, stored, and of a bounded sample of their labels.

    ``LABELLED`` ids by their hash are labelled rows; an id labelled both ways counts as bad, and of several documents
    of an id the one with the smallest views is read. All other documents with an id that is not held out are unlabelled
    rows, each of them in every round. None where labels of one kind have under three documents.
    """
    ship(views.sparkSession)
    usable = labels.where(~held_out(F.col("doc_id")) & F.col("quality").isNotNull() & F.col("doc_id").isNotNull())
    there = usable.groupBy("doc_id").agg(F.min("quality").alias("quality")).join(
        views.select("doc_id"), "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(LABELLED).collect()
    chosen = [(r.doc_id, int(r.quality > 0)) for r in there]
    if len({y for _, y in chosen}) < 2:
        return None
    ids = F.broadcast(views.sparkSession.createDataFrame(chosen, "doc_id long, label int"))
    found = views.join(ids, "doc_id").groupBy("doc_id", "label").agg(F.min(F.struct("features", "hashed")).alias("one")).collect()
    found.sort(key=lambda r: r.doc_id)
    known = _matrices(pa.array([r.one.features for r in found], pa.list_(pa.float64())),
                      pa.array([r.one.hashed for r in found], pa.list_(pa.int32())))
    free = views.where(~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull()).join(ids, "doc_id", "left_anti")
    return cotrain(known["text"], known["meta"], np.array([r.label for r in found], dtype=float), StoredRows(free))


def score(views: DataFrame, model: Model | None) -> DataFrame:
    """``described`` documents with ``score``, 0 to 1, higher for better ones.

    Empty texts have zero features and are scored as such, very long ones by the same features. Without a model (labels
    of one kind only) every score is 0.5. Repeated rows score alike, equal scores need no order, an empty table stays
    empty. A column ``score`` is replaced, all others pass untouched.
    """
    ship(views.sparkSession)
    sent = views.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def scores(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for features, hashed in batches:
            if sent.value is None or not len(features):
                yield pa.array(np.full(len(features), 0.5))
                continue
            rows = _matrices(features, hashed)
            yield pa.array(sent.value.scores(rows["text"], rows["meta"]))

    return views.withColumn("score", scores("features", "hashed"))


def scored(docs: DataFrame, labels: DataFrame, pages: DataFrame) -> DataFrame:
    """Per document: whether it is held out, its score, and the label predicted from it."""
    views = stored(described(docs, pages), "views")
    return score(views, train(views, labels)).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
