"""Toxic spans by a linear-chain conditional random field, and document scores from its marginals.

Tokens are labelled from labelled documents: a token of a toxic document is toxic where its word, or a prefix of it,
is tied to toxic documents. The field (two states, word and neighbour weights, transitions) is fitted to those tokens;
forward-backward gives each token's marginal in any text. Marginals are summed per document and calibrated.

The sample stays with the executors: features are counted by an aggregate, and each round of fitting sums gradients
where the tokens are stored. The driver holds the weights and one pair of sums per sampled document.
"""

from __future__ import annotations

import itertools
import re
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import own_name, ship, stored, table, text_of

# The bounded sample that the field is fitted on: so many documents per label, each whole.
SAMPLE_DOCUMENTS = 1000
# The field has weights for features that tell the labels apart with this evidence (95 % of chance), in at least so many
# sampled documents; if there are more than so many features, for those in the most documents.
LEAST_TOLD, LEAST_DOCUMENTS, FEATURES = 3.84, 3, 200_000
# The sample is stored in so many parts, tokenised in blocks of about so many code points.
FIT_PARTS, BLOCK_CHARS = 16, 500_000
# A feature marks toxic tokens at this evidence (likelihood ratio statistic) and share of toxic documents.
LEAST_EVIDENCE, LEAST_SHARE = 20.0, 0.7
PREFIXES = (4, 5, 6, 7)
ROUNDS, STEP, PENALTY = 40, 1.0, 0.02
# Texts are tagged together up to this many tokens; words are remembered up to this many.
BATCH_TOKENS, REMEMBER_WORDS = 400_000, 200_000
SPAN_MARGINAL = 0.5
# Smaller marginals count as 0 wherever the method's marginals are used, in fitting the calibration as in scoring: else
# the many unknown words of a long text would add up. A document whose every token is below has the score of no token.
LEAST_MARGINAL = 0.1
# A document scores as toxic from this on.
THRESHOLD = 0.5

_TOKEN = re.compile(r"\w+|[.!?\n]")
_ENDS = frozenset(".!?\n")


def _features(word: str) -> list[int]:
    """Hashes of the word and of its prefixes, in lower case."""
    low = word.lower()
    return [zlib.crc32(x.encode()) for x in (low, *(f"{low[:k]}*" for k in PREFIXES if len(low) > k))]


class Chains(NamedTuple):
    """Tokens of many texts in a row, cut into chains at sentence ends."""

    word: np.ndarray
    text: np.ndarray
    starts: np.ndarray
    lengths: np.ndarray


def _chains(texts: list[str], numbers: dict[str, int], learn) -> Chains:
    """``numbers`` has the number of each word; ``learn`` adds a word to it."""
    words, text = [], []
    for t in texts:
        found = _TOKEN.findall(t)
        words += found
        words.append("\n")
        text.append(len(found) + 1)
    numbers.update(dict.fromkeys(_ENDS, -1))
    for word in set(words).difference(numbers):
        learn(word)
    number = np.fromiter(map(numbers.__getitem__, words), dtype=np.int64, count=len(words))
    of = np.repeat(np.arange(len(texts)), text)
    real = number >= 0
    chain = np.cumsum(~real)[real]
    starts = np.flatnonzero(np.r_[True, chain[1:] != chain[:-1]]) if len(chain) else np.zeros(0, dtype=np.int64)
    return Chains(number[real], of[real], starts, np.diff(np.r_[starts, len(chain)]))


class Field(NamedTuple):
    """Log weights: each feature on its token, its right and its left neighbour; the four transitions; the start."""

    weights: dict[int, tuple[float, float, float]]
    bias: float
    transitions: np.ndarray
    calibration: np.ndarray


def _neighbours(c: Chains, own: np.ndarray, to_right: np.ndarray, to_left: np.ndarray) -> np.ndarray:
    """Log odds of the toxic state at each token, before transitions."""
    out = own[c.word]
    inner = np.ones(len(c.word), dtype=bool)
    inner[c.starts] = False
    right = np.flatnonzero(inner)
    out[right] += to_right[c.word[right - 1]]
    out[right - 1] += to_left[c.word[right]]
    return np.clip(out, -25, 25)


def _marginals(c: Chains, odds: np.ndarray, t: np.ndarray, pairs: bool = False):
    """The toxic marginal of each token, and with ``pairs`` the expected count of each transition.

    Ratios of the two states are passed forward and backward along all chains at once, the longest first.
    """
    e, order = np.exp(odds), np.argsort(-c.lengths, kind="stable")
    starts, lengths = c.starts[order], c.lengths[order]
    ahead, back = np.ones(len(odds)), np.ones(len(odds))
    live = [int(x) for x in np.searchsorted(-lengths, -np.arange(1, (lengths[0] if len(lengths) else 0) + 1), side="right")]
    w = np.exp(t)
    for step, n in enumerate(live):
        at = starts[:n] + step
        if step:
            r = ahead[at - 1]
            ahead[at] = e[at] * (w[0, 1] + w[1, 1] * r) / (w[0, 0] + w[1, 0] * r)
        else:
            ahead[at] = e[at]
    np.clip(ahead, 1e-30, 1e30, out=ahead)
    for step in range(len(live) - 2, -1, -1):
        at = starts[:live[step + 1]] + step
        r = e[at + 1] * back[at + 1]
        back[at] = (w[1, 0] + w[1, 1] * r) / (w[0, 0] + w[0, 1] * r)
    odds_all = ahead * back
    p = odds_all / (1 + odds_all)
    if not pairs:
        return p
    inner = np.ones(len(odds), dtype=bool)
    inner[c.starts] = False
    at = np.flatnonzero(inner)
    a, b = ahead[at - 1], e[at] * back[at]
    each = [w[0, 0] * np.ones(len(at)), w[0, 1] * b, w[1, 0] * a, w[1, 1] * a * b]
    total = sum(each)
    return p, np.array([(x / total).sum() for x in each]).reshape(2, 2)


def _evidence(a: np.ndarray, b: np.ndarray, n1: int, n0: int) -> np.ndarray:
    """Likelihood ratio statistic of a feature in a of n1 toxic and b of n0 other documents."""
    n, k = n1 + n0, a + b

    def part(seen, expected):
        return np.where(seen > 0, seen * np.log(np.maximum(seen, 1e-9) / np.maximum(expected, 1e-9)), 0.0)

    return 2 * (part(a, n1 * k / n) + part(b, n0 * k / n) + part(n1 - a, n1 * (n - k) / n) + part(n0 - b, n0 * (n - k) / n))


def document_features(text: str) -> list[int]:
    """The distinct features of a text."""
    words = {w.lower() for w in _TOKEN.findall(text) if w not in _ENDS}
    return sorted({f for w in words for f in _features(w)})


class Marks(NamedTuple):
    """Features that have weights, in ascending order, and which of them mark toxic tokens."""

    names: np.ndarray
    marking: np.ndarray


def marks(names: np.ndarray, toxic: np.ndarray, other: np.ndarray, n1: int, n0: int) -> Marks:
    """From the numbers of toxic and other documents that have each feature, of n1 and n0."""
    order = np.argsort(names)
    a, b = toxic[order].astype(float), other[order].astype(float)
    evidence = _evidence(a, b, n1, n0)
    marking = (evidence >= LEAST_EVIDENCE) & (a / n1 >= LEAST_SHARE * (a / n1 + b / n0)) & (a / n1 > 5 * b / n0)
    told = evidence >= LEAST_TOLD
    return Marks(names[order][told], marking[told])


def _evidence_column(toxic: Column, other: Column, n1: int, n0: int) -> Column:
    """``_evidence`` of two counts as a column."""
    n, k = n1 + n0, toxic + other

    def part(seen: Column, expected: Column) -> Column:
        return F.when(seen > 0, seen * F.ln(seen / expected)).otherwise(0.0)

    return 2 * (part(toxic, n1 * k / n) + part(other, n0 * k / n)
                + part(n1 - toxic, n1 * (n - k) / n) + part(n0 - other, n0 * (n - k) / n))


class Block(NamedTuple):
    """Tokens of some sampled documents, and the features of each distinct word as pairs (word, place in the names)."""

    chains: Chains
    word: np.ndarray
    feature: np.ndarray
    target: np.ndarray


def block(texts: list[str], labels: list[int], known: Marks) -> Block:
    """A token is a target where its document is toxic and its word has a marking feature."""
    numbers: dict[str, int] = {}
    rows, features = [], []

    def learn(word: str) -> None:
        numbers[word] = len(rows)
        rows.append(len(features))
        features.extend(_features(word))

    chains = _chains(texts, numbers, learn)
    found = np.array(features, dtype=np.int64)
    word = np.repeat(np.arange(len(rows)), np.diff([*rows, len(features)]))
    at = np.minimum(np.searchsorted(known.names, found), max(0, len(known.names) - 1))
    has = known.names[at] == found if len(known.names) else np.zeros(len(found), dtype=bool)
    word, at = word[has], at[has]
    marked = np.zeros(len(rows), dtype=bool)
    marked[word[known.marking[at]]] = True
    toxic = np.array(labels, dtype=bool)
    return Block(chains, word, at, marked[chains.word] & toxic[chains.text])


_BLOCK_TYPES = [np.int32, np.int32, np.int64, np.int64, np.int32, np.int32, np.bool_]


def _packed(b: Block) -> list[bytes]:
    arrays = [*b.chains, b.word, b.feature, b.target]
    return [np.ascontiguousarray(x, dtype=t).tobytes() for x, t in zip(arrays, _BLOCK_TYPES, strict=True)]


def _unpacked(row: list[bytes]) -> Block:
    word, text, starts, lengths, *rest = (np.frombuffer(x, dtype=t) for x, t in zip(row, _BLOCK_TYPES, strict=True))
    return Block(Chains(word, text, starts, lengths), *rest)


_BLOCK_SCHEMA = pa.schema([
    ("ids", pa.list_(pa.int64())), ("labels", pa.list_(pa.int32())),
    *((x, pa.binary()) for x in ("word", "text", "starts", "lengths", "of_word", "feature", "target"))])
_BLOCK_SQL = ("ids array<long>, labels array<int>, word binary, text binary, starts binary, lengths binary, "
              "of_word binary, feature binary, target binary")


class Weights(NamedTuple):
    """Of each feature on its token, its right and its left neighbour; the four transitions; the start."""

    features: np.ndarray
    transitions: np.ndarray
    bias: float

    @staticmethod
    def of(flat: np.ndarray) -> Weights:
        return Weights(flat[:-5].reshape(3, -1), flat[-5:-1].reshape(2, 2), float(flat[-1]))


def _odds(b: Block, w: Weights) -> np.ndarray:
    size = int(b.chains.word.max()) + 1 if len(b.chains.word) else 0
    own, right, left = (np.bincount(b.word, weights=x[b.feature], minlength=size) for x in w.features)
    return _neighbours(b.chains, own + w.bias, right, left)


def gradient(b: Block, w: Weights) -> np.ndarray:
    """The gradient of the block's likelihood, flat: features, transitions, start."""
    c, size = b.chains, w.features.shape[1]
    words = int(c.word.max()) + 1 if len(c.word) else 0
    p, expected = _marginals(c, _odds(b, w), w.transitions, pairs=True)
    inner = np.ones(len(c.word), dtype=bool)
    inner[c.starts] = False
    right = np.flatnonzero(inner)
    now, was = b.target[right].astype(int), b.target[right - 1].astype(int)
    seen = np.bincount(2 * was + now, minlength=4).reshape(2, 2)
    wrong = b.target - p
    by_word = (np.bincount(c.word, weights=wrong, minlength=words),
               np.bincount(c.word[right - 1], weights=wrong[right], minlength=words),
               np.bincount(c.word[right], weights=wrong[right - 1], minlength=words))
    per_feature = [np.bincount(b.feature, weights=x[b.word], minlength=size) for x in by_word]
    return np.concatenate([*per_feature, (seen - expected).ravel(), [wrong.sum()]])


def document_sums(b: Block, w: Weights, documents: int) -> np.ndarray:
    """Per document of the block the sum and the largest of its marginals from ``LEAST_MARGINAL`` on."""
    p = _marginals(b.chains, _odds(b, w), w.transitions)
    p[p < LEAST_MARGINAL] = 0
    out = np.zeros((documents, 2))
    out[:, 0] = np.bincount(b.chains.text, weights=p, minlength=documents)
    np.maximum.at(out[:, 1], b.chains.text, p)
    return out


def climb(size: int, total: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Weights after ``ROUNDS`` steps; ``total`` gives the gradient over the whole sample. Steps shrink with those met so far."""
    flat = np.zeros(3 * size + 5)
    flat[-1] = -3.0
    squares, penalty = np.full(len(flat), 1e-3), np.r_[np.full(3 * size + 4, PENALTY), 0.0]
    for _ in range(ROUNDS):
        grad = total(flat) - penalty * flat
        squares += grad**2
        flat = flat + STEP * grad / np.sqrt(squares)
    return flat


def _field(known: Marks, flat: np.ndarray, sums: np.ndarray, labels: np.ndarray, priors: tuple[int, int]) -> Field:
    w = Weights.of(flat)
    kept = np.flatnonzero(np.abs(w.features).max(axis=0, initial=0) > 1e-4)
    return Field(dict(zip(known.names[kept].tolist(), map(tuple, w.features[:, kept].T.tolist()), strict=True)),
                 w.bias, w.transitions, _calibrate(sums, labels, priors))


def fit(texts: list[str], labels: list[int], priors: tuple[int, int]) -> Field | None:
    """The field of a few labelled texts, in memory; None where one label is missing. ``priors``: rows of each label."""
    y = np.array(labels, dtype=bool)
    n1, n0 = int(y.sum()), int((~y).sum())
    if not n1 or not n0:
        return None
    seen = defaultdict(lambda: [0, 0])
    for text, label in zip(texts, labels, strict=True):
        for f in document_features(text):
            seen[f][int(label)] += 1
    often = {f: x for f, x in seen.items() if sum(x) >= LEAST_DOCUMENTS}
    counts = np.array(list(often.values()), dtype=np.int64).reshape(-1, 2)
    known = marks(np.array(list(often), dtype=np.int64), counts[:, 1], counts[:, 0], n1, n0)
    whole = block(texts, labels, known)
    flat = climb(len(known.names), lambda at: gradient(whole, Weights.of(at)))
    return _field(known, flat, document_sums(whole, Weights.of(flat), len(texts)), y, priors)


def _inputs(sums: np.ndarray) -> np.ndarray:
    """Of each document: constant, sum and largest of the marginals, and whether more than one token is toxic."""
    total, most = sums[:, 0], sums[:, 1]
    return np.stack([np.ones(len(total)), np.log1p(total), most, np.clip(total - 1, 0, 1)], axis=1)


def _calibrate(sums: np.ndarray, y: np.ndarray, priors: tuple[int, int]) -> np.ndarray:
    """Logistic weights from sums to the label, each label weighing as often as it occurs in all rows."""
    x, beta = _inputs(sums), np.zeros(4)
    share = priors[1] / max(1, sum(priors))
    weight = np.where(y, share / y.mean(), (1 - share) / (1 - y).mean())
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        curve = (x * (weight * p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(4)
        beta += np.linalg.solve(curve, x.T @ (weight * (y - p)) - 0.1 * beta)
    return beta


class Tagger:
    """A field applied to texts; each distinct word's weights are looked up once and remembered."""

    def __init__(self, field: Field):
        self.field = field
        self._clear()

    def _clear(self) -> None:
        self.known: dict[str, int] = {}
        self._values: list[tuple[float, float, float]] = []

    def _learn(self, word: str) -> None:
        self.known[word] = len(self._values)
        found = [x for f in _features(word) if (x := self.field.weights.get(f))]
        self._values.append(tuple(map(sum, zip(*found, strict=True))) if found else (0.0, 0.0, 0.0))

    def marginals(self, texts: list[str]) -> tuple[Chains, np.ndarray]:
        """The chains, and the marginal of each token; 0 where it is proven to be under ``LEAST_MARGINAL``."""
        if len(self.known) > REMEMBER_WORDS:
            self._clear()
        c = _chains(texts, self.known, self._learn)
        own, right, left = np.array(self._values).reshape(-1, 3).T
        odds, w = _neighbours(c, own + self.field.bias, right, left), np.exp(self.field.transitions)
        p = np.zeros(len(odds))
        if len(odds):
            # What comes along the chain multiplies the odds of a token by no more than this on either side.
            most = max(w[0, 1] / w[0, 0], w[1, 1] / w[1, 0], 1) * max(w[1, 0] / w[0, 0], w[1, 1] / w[0, 1], 1)
            high = np.maximum.reduceat(odds, c.starts) + np.log(most) >= np.log(LEAST_MARGINAL / (1 - LEAST_MARGINAL))
            at = np.repeat(high, c.lengths)
            lengths = c.lengths[high]
            few = Chains(c.word[at], c.text[at], np.cumsum(lengths) - lengths, lengths)
            p[at] = _marginals(few, odds[at], self.field.transitions)
            p[p < LEAST_MARGINAL] = 0
        return c, p

    def sums(self, texts: list[str]) -> np.ndarray:
        """Per text the sum and the largest of its tokens' marginals from ``LEAST_MARGINAL`` on."""
        out, done = np.zeros((len(texts), 2)), 0
        for group in _groups(texts):
            c, p = self.marginals(group)
            part, hit = out[done:done + len(group)], np.flatnonzero(p)
            part[:, 0] = np.bincount(c.text[hit], weights=p[hit], minlength=len(group))
            np.maximum.at(part[:, 1], c.text[hit], p[hit])
            done += len(group)
        return out

    def scores(self, texts: list[str]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(_inputs(self.sums(texts)) @ self.field.calibration, -30, 30)))

    def spans(self, text: str) -> list[tuple[int, int, float]]:
        """Runs of toxic tokens: start, end (exclusive, code points) and largest marginal."""
        _, p = self.marginals([text])
        words = [m.span() for m in _TOKEN.finditer(text) if m[0] not in _ENDS]
        out: list[tuple[int, int, float]] = []
        before = -2
        for i in np.flatnonzero(p >= SPAN_MARGINAL).tolist():
            if i == before + 1:
                out[-1] = (out[-1][0], words[i][1], max(out[-1][2], float(p[i])))
            else:
                out.append((*words[i], float(p[i])))
            before = i
        return out


def _groups(texts: list[str], size: int = 5 * BATCH_TOKENS) -> Iterator[list[str]]:
    group, chars = [], 0
    for text in texts:
        group.append(text)
        chars += len(text)
        if chars >= size:
            yield group
            group, chars = [], 0
    if group:
        yield group


def held_out(doc_id):
    """Rows whose labels are never learned from; a NULL id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame) -> Field | None:
    """The field of a bounded sample of the labelled documents that are not held out.

    ``SAMPLE_DOCUMENTS`` documents of each label, by a hash of the id, are read whole, whatever their length. An id
    labelled both ways counts as toxic, rows of one id are one label, and of several texts of an id the smallest is
    read. None where a label has no document with a text. NULL ids and texts teach nothing.
    """
    ship(docs.sparkSession)
    usable = labels.where(~held_out(F.col("doc_id")) & F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy(
        F.col("doc_id").cast("long").alias("doc_id")).agg(F.max((F.col("toxic") > 0).cast("int")).alias("label"))
    counts = {r.label: r.n for r in usable.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    there = usable.join(docs.where(F.col("text").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id")),
                        "doc_id", "left_semi")
    chosen: dict[int, int] = {}
    for label in (0, 1):
        rows = there.where(F.col("label") == label).select("doc_id")
        chosen |= {r.doc_id: label for r in rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_DOCUMENTS).collect()}
    if len(set(chosen.values())) < 2:
        return None
    ids = docs.sparkSession.createDataFrame(list(chosen.items()), "_id long, label int")
    texts = docs.where(F.col("text").isNotNull()).select("doc_id", "text").join(
        F.broadcast(ids), F.col("doc_id").cast("long") == F.col("_id")).groupBy("_id", "label").agg(F.min("text").alias("text"))
    # One order of the documents in each part, so that equal inputs give equal sums.
    sample = stored(texts.repartition(FIT_PARTS, "_id").sortWithinPartitions("_id"), "toxicity_sample")
    return fit_stored(sample, list(chosen.values()), (counts.get(0, 0), counts.get(1, 0)))


def fit_stored(sample: DataFrame, labels: list[int], priors: tuple[int, int]) -> Field:
    """The field of a stored sample (``_id``, ``label``, ``text``), fitted where its rows are; as ``fit`` in memory."""
    spark = sample.sparkSession
    n1, n0 = sum(labels), len(labels) - sum(labels)

    @F.pandas_udf("array<long>")
    def features(texts: pd.Series) -> pd.Series:
        return pd.Series([document_features(t) for t in texts], dtype=object)

    toxic, other = F.sum("label").alias("toxic"), F.sum(1 - F.col("label")).alias("other")
    often = stored(sample.select("label", F.explode(features("text")).alias("feature")).groupBy("feature").agg(
        toxic, other).withColumn("documents", F.col("toxic") + F.col("other")).where(
        F.col("documents") >= LEAST_DOCUMENTS).where(
        _evidence_column(F.col("toxic"), F.col("other"), n1, n0) >= 0.999 * LEAST_TOLD), "toxicity_features")
    least, room = LEAST_DOCUMENTS, FEATURES
    for r in often.groupBy("documents").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("documents")).collect():
        room -= r.n
        if room < 0:
            least = r.documents + 1
            break
    seen = often.where(F.col("documents") >= least).toPandas()
    known = marks(*(seen[c].to_numpy(dtype=np.int64) for c in ("feature", "toxic", "other")), n1, n0)
    size, sent = len(known.names), spark.sparkContext.broadcast(known)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label = iter(batch.column(1).to_pylist())
            ids = iter(batch.column(0).to_pylist())
            for group in _groups(batch.column(2).to_pylist(), BLOCK_CHARS):
                own, about = list(itertools.islice(ids, len(group))), list(itertools.islice(label, len(group)))
                b = block(group, about, sent.value)
                yield pa.RecordBatch.from_arrays([pa.array([x], t.type) for x, t in zip(
                    [own, about, *_packed(b)], _BLOCK_SCHEMA, strict=True)], schema=_BLOCK_SCHEMA)

    cut = stored(sample.select("_id", "label", "text").mapInArrow(blocks, _BLOCK_SQL), "toxicity_blocks")

    def total(flat: np.ndarray) -> np.ndarray:
        weights = spark.sparkContext.broadcast(flat)

        def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at, grad = Weights.of(weights.value), np.zeros(3 * size + 5)
            for batch in batches:
                for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    grad += gradient(_unpacked(row), at)
            yield pa.RecordBatch.from_pydict({"gradient": [grad.tobytes()]})

        parts = cut.drop("ids", "labels").mapInArrow(step, "gradient binary").collect()
        weights.destroy()
        return sum((np.frombuffer(r.gradient) for r in parts), np.zeros(3 * size + 5))

    flat = climb(size, total)
    weights = spark.sparkContext.broadcast(flat)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own, about, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                sums = document_sums(_unpacked(row), Weights.of(weights.value), len(own))
                yield pa.RecordBatch.from_pydict(
                    {"id": own, "label": pa.array(about, pa.int32()), "total": sums[:, 0], "most": sums[:, 1]})

    rows = sorted(tuple(r) for r in cut.mapInArrow(summed, "id long, label int, total double, most double").collect())
    sums = np.array([r[2:] for r in rows])
    return _field(known, flat, sums, np.array([r[1] for r in rows], dtype=bool), priors)


def tag(docs: DataFrame, field: Field | None, text: str = "text", spans: bool = True) -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and, on request, ``spans``: start, end and marginal of toxic runs.

    The whole text is read, offsets are code points. NULL and empty texts have no token and score as such; without a
    field (no labels of both kinds) every score is 0. Rows are independent: repeated rows score alike, an empty table
    stays empty. Columns named like the new ones are replaced, all others pass untouched.
    """
    ship(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(field)
    out = own_name(docs, "_tagged")

    @F.pandas_udf("score double, spans array<struct<start:int,end:int,marginal:double>>")
    def tagged(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        tagger = Tagger(sent.value) if sent.value else None
        for batch in batches:
            texts = batch.tolist()
            scores = tagger.scores(texts) if tagger else np.zeros(len(texts))
            found = [
                [dict(zip(("start", "end", "marginal"), s, strict=True)) for s in tagger.spans(t)]
                if spans and tagger and score >= 0.01 else [] for t, score in zip(texts, scores, strict=True)
            ]
            yield pd.DataFrame({"score": scores, "spans": found})

    new = ["score", "spans"] if spans else ["score"]
    kept = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in new]
    return docs.withColumn(out, tagged(text_of(text))).select(*kept, *(F.col(f"{out}.{x}").alias(x) for x in new))


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document: whether it is held out, its score, and the label predicted from it."""
    field = train(docs, labels)
    return tag(docs.select("doc_id", "text"), field, spans=False).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def clean(docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that are not toxic."""
    field = train(docs, table(docs.sparkSession, sf_dir, "labels"))
    score = own_name(docs, "score")
    tagged = tag(docs.withColumnRenamed("score", score), field, spans=False)
    return tagged.where(F.col("score") < THRESHOLD).drop("score").withColumnRenamed(score, "score").select(docs.columns)
