"""Personal data: base patterns as seeds, and further identifiers by the words before them, in column expressions only.

Chunks that look like an identifier are instances; the words before a chunk are its pattern. Seeds score 1 for their
kind. In rounds a pattern scores the mean of its instances and an unknown instance the best of its patterns. Patterns
that score high over enough seeds are accepted, what stands behind them are seeds of the next round, and so on until no
pattern is added; chunks behind accepted patterns are spans too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import own_name, stored, text_of

# The base patterns. A run of their letters is tried from its start, or from the end of the match before,
# never from within: no match would begin there.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
KINDS = tuple(PATTERNS)
# What may be an identifier: two names around a written-out or real at sign, or a number of four digits and more, with
# the separators that people write.
INSTANCE = (
    r"(?:(?<![^\s@,;:<>\x22()\[\]])|\G)[^\s@,;:<>\x22()\[\]]++(?:@|[(\[]at[)\]])[^\s@,;<>\x22()\[\]]++"
    r"|(?<![\w.])[+(]?[0-9](?:[().\x20-]*+[0-9]){3,}+"
)
# The words before an instance are sought among so many code points; of two patterns, one has one word, one has two.
CONTEXT_CHARS = 60
# Rounds at least; there are more as long as patterns are added.
ROUNDS = 3
# A pattern is accepted with this many distinct seeds of its kind, base or found before, and from this score on.
LEAST_INSTANCES, LEAST_SCORE = 5, 0.8
# Running sums are taken in blocks of so many.
_BLOCK = 128


def _before(lengths: Column) -> Column:
    """For each element the sum of those before it; sums within blocks and over blocks keep it far from quadratic."""
    size = F.size(lengths)
    starts = F.sequence(F.lit(0), F.floor((size - 1) / _BLOCK).cast("int"))

    def total(part: Column) -> Column:
        return F.aggregate(part, F.lit(0), lambda a, x: a + x)

    def of_blocks(blocks: Column) -> Column:
        def of_totals(totals: Column) -> Column:
            return F.flatten(F.transform(blocks, lambda b, i: F.transform(
                b, lambda _, j: total(F.slice(totals, 1, i)) + total(F.slice(b, 1, j)))))

        return F.transform(F.array(F.transform(blocks, total)), of_totals)[0]

    blocks = F.transform(starts, lambda i: F.slice(lengths, i * _BLOCK + 1, _BLOCK))
    return F.when(size > 0, F.transform(F.array(blocks), of_blocks)[0]).otherwise(F.slice(lengths, 1, 0))


def _matches(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches: array of (start, end, value, gap), ends exclusive, in code points.

    ``gap`` is the text since the match before.
    """
    gaps, values = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def placed(pairs: Column) -> Column:
        return F.zip_with(pairs, _before(F.transform(pairs, lambda p: F.length(p["gap"]) + F.length(p["value"]))),
                          lambda p, at: F.struct(
                              (at + F.length(p["gap"])).alias("start"),
                              (at + F.length(p["gap"]) + F.length(p["value"])).alias("end"),
                              p["value"].alias("value"), p["gap"].alias("gap")))

    pairs = F.transform(F.array(gaps), lambda g: F.transform(
        values, lambda v, i: F.struct(v.alias("value"), g[i].alias("gap"))))[0]
    return F.transform(F.array(pairs), placed)[0]


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether the digits pass the check, every second from the right doubled."""
    n = F.length(digits)

    def worth(i: Column) -> Column:
        d = F.substr(digits, n - i, F.lit(1)).cast("int")
        return F.when(i % 2 == 0, d).when(d < 5, 2 * d).otherwise(2 * d - 9)

    return F.aggregate(F.transform(F.sequence(F.lit(0), n - 1), worth), F.lit(0), lambda a, x: a + x) % 10 == 0


def _holds(kind: str, value: Column) -> Column:
    """Whether a match of the kind's pattern is kept."""
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: p.cast("double") <= 255)
    if kind == "card":
        digits = _digits(value)
        return F.when(F.length(digits).between(13, 19), _luhn(digits)).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(_digits(value)).between(9, 15)
    return F.lit(True)


def base_spans(text: Column, kind: str) -> Column:
    """The base spans of a kind: array of (start, end)."""
    found = F.filter(_matches(text, PATTERNS[kind]), lambda m: _holds(kind, m["value"]))
    return F.transform(found, lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end")))


def _seed_kind(value: Column) -> Column:
    """The kind whose base pattern a whole instance is, if any."""
    out = F.when(value.rlike(f"^(?:{PATTERNS['email']})$"), "email")
    for kind in ("ip", "phone", "card"):
        out = out.when(value.rlike(f"^(?:{PATTERNS[kind]})$") & _holds(kind, value), kind)
    return out


def instances(docs: DataFrame) -> DataFrame:
    """Every identifier-like chunk of every text with each of its patterns.

    ``doc_id``, ``start``, ``end``, ``value`` (a digest of the chunk), ``kind`` (of a seed, else NULL) and ``pattern``.
    """
    found = docs.select("doc_id", F.explode(_matches(text_of("text"), INSTANCE)).alias("m")).select(
        "doc_id", "m.start", "m.end", "m.value", F.lower(F.expr(f"right(m.gap, {CONTEXT_CHARS})")).alias("gap"))
    # The last words before the chunk in the same line; a cut-off first word doesn't count.
    words = F.filter(F.split(F.regexp_extract("gap", r"(?:^|[\n.!?])?([^\n]*)$", 1), r"\s+"), lambda w: w.rlike(r"\p{L}"))
    spelled = found.withColumn("words", words).withColumn("n", F.size("words"))
    last = F.element_at("words", -1)
    patterns = F.filter(F.array(
        F.when(F.col("n") >= 1, last),
        F.when(F.col("n") >= 2, F.concat_ws(" ", F.element_at("words", -2), last)),
    ), lambda p: p.isNotNull())
    safe = F.when(F.col("n") >= 2, patterns).when(F.col("n") == 1, F.array(last)).otherwise(F.array().cast("array<string>"))
    return spelled.select(
        "doc_id", "start", "end", F.xxhash64("value").alias("value"), _seed_kind(F.col("value")).alias("kind"),
        F.explode(safe).alias("pattern"))


def pattern_scores(found: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """The accepted patterns: (pattern, kind, score), from ``instances``.

    The graph has one edge for each pattern and distinct instance. A seed scores 1 for its kind and 0 for others, an
    unknown instance per kind the best of its patterns in the round before, each weakened where it has few instances. A
    pattern stays accepted with its best score. Unknown instances behind accepted patterns are seeds of the pattern with
    the best score from the next round on. Rounds end when none is added, after ``rounds`` of them at least.
    """
    edges = stored(found.groupBy("pattern", "value").agg(F.max("kind").alias("seed")), "pattern_edges")
    # Patterns without a single seed can't gain from others than through shared instances; kinds are apart.
    kinds = F.explode(F.array(*(F.lit(k) for k in KINDS)))
    known = (F.col("seed") == F.col("kind")).cast("double")
    scores = accepted = None
    labelled, number, turn = edges, 0, 0
    while True:
        graph = labelled.select("pattern", "value", "seed", kinds.alias("kind"))
        if scores is None:
            scored = graph.withColumn("score", F.coalesce(known, F.lit(0.0)))
        else:
            best = labelled.where("seed IS NULL").join(scores, "pattern").groupBy("value", "kind").agg(
                F.max("weak").alias("best"))
            scored = graph.join(best, ["value", "kind"], "left").withColumn(
                "score", F.when(F.col("seed").isNotNull(), known).otherwise(F.coalesce("best", F.lit(0.0))))
        scores = stored(scored.groupBy("pattern", "kind").agg(
            F.avg("score").alias("score"), F.sum("score").alias("sum"), F.sum(F.coalesce(known, F.lit(0.0))).alias("seeds"),
        ).where("sum > 0").withColumn("weak", F.col("score") * F.col("sum") / (F.col("sum") + 2)), "pattern_scores")
        now = scores.where((F.col("seeds") >= LEAST_INSTANCES) & (F.col("score") >= LEAST_SCORE)).select(
            "pattern", "kind", "score")
        if accepted is not None:
            now = accepted.unionByName(now).groupBy("pattern", "kind").agg(F.max("score").alias("score"))
        accepted, before, turn = stored(now, "patterns"), number, turn + 1
        number = accepted.count()
        if number == before and turn >= rounds:
            return accepted
        if number > before:
            more = edges.where("seed IS NULL").join(accepted, "pattern").groupBy("value").agg(
                F.max(F.struct("score", "kind")).alias("best")).select("value", F.col("best.kind").alias("more"))
            labelled = stored(edges.join(more, "value", "left").select(
                "pattern", "value", F.coalesce("seed", "more").alias("seed")), "pattern_edges")


def discovered(docs: DataFrame) -> DataFrame:
    """Spans behind high-scoring patterns that are no seeds: ``doc_id``, ``start``, ``end``, ``kind``."""
    found = stored(instances(docs), "instances")
    scores = pattern_scores(found)
    return (
        found.where("kind IS NULL").drop("kind").join(scores, "pattern")
        .groupBy("doc_id", "start", "end").agg(F.max(F.struct("score", "kind")).alias("best"))
        .select("doc_id", "start", "end", F.col("best.kind").alias("kind"))
    )


def _listed(spans: Column) -> Column:
    """Spans as kind:start:end, comma-joined, by kind in the listed order, then start."""
    return F.array_join(spans, ",")


def find(docs: DataFrame) -> DataFrame:
    """``docs`` with ``base``, one array of (start, end) per kind, and ``extra``, discovered (kind, start, end).

    Offsets are code points of the whole text, ends exclusive. NULL and empty texts have no spans, very long ones are read
    to their end. Discovered spans that overlap a base span are left out, so base spans always stay; of kinds with equal
    scores the last by name is told. Rows are known by their doc_id and text, so repeated
    rows have the same spans; an empty table stays empty. Columns named like the new ones are replaced, all others pass
    untouched.
    """
    key, mark, text = own_name(docs, "_text"), own_name(docs, "_row"), text_of("text")
    row = F.xxhash64(F.col("doc_id"), text)
    kept = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("base", "extra")]
    extra = discovered(docs.select(row.alias("doc_id"), "text")).groupBy(F.col("doc_id").alias(mark)).agg(
        F.collect_set(F.struct("kind", "start", "end")).alias("extra"))
    base = F.struct(*(base_spans(text, kind).alias(kind) for kind in KINDS))
    rows = docs.select(*kept, base.alias("base"), row.alias(key))
    joined = rows.join(extra, rows[key] == extra[mark], "left").drop(key, mark)

    def free(x: Column) -> Column:
        crossing = F.lit(False)
        for kind in KINDS:
            crossing = crossing | F.exists(
                F.col(f"base.{kind}"), lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"]))
        return ~crossing

    none = F.array().cast("array<struct<kind:string,start:int,end:int>>")
    return joined.withColumn("extra", F.filter(F.coalesce(F.col("extra"), none), free))


def digests(docs: DataFrame) -> DataFrame:
    """Per document: base spans by kind, a digest of them, and all spans with the discovered ones."""

    def texts(kind: str) -> Column:
        return F.transform(F.col(f"base.{kind}"), lambda s: F.concat_ws(":", F.lit(kind), s["start"], s["end"]))

    def all_of(kind: str) -> Column:
        more = F.filter("extra", lambda x: x["kind"] == kind)
        spans = F.concat(F.col(f"base.{kind}"), F.transform(more, lambda x: F.struct(
            x["start"].alias("start"), x["end"].alias("end"))))
        return F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.lit(kind), s["start"], s["end"]))

    found = find(docs.select("doc_id", "text"))
    return found.select(
        "doc_id", *(F.size(f"base.{k}").cast("long").alias(f"n_{k}") for k in KINDS),
        F.sha2(_listed(F.concat(*(texts(k) for k in KINDS))).cast("binary"), 256).alias("base_sha256"),
        _listed(F.concat(*(all_of(k) for k in KINDS))).alias("spans"))
