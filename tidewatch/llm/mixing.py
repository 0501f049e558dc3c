"""Mixing sources to target weights by iterative proportional fitting, in DataFrame operations only.

Tokens are counted per cell (source, language, topic). In turn for each of the three, the weights of the cells are
scaled so that its weighted shares of tokens meet their targets; after some rounds all three nearly do. A document is
sampled with a probability in proportion to its cell's weight.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.common import own_name, stored, text_of
from tidewatch.operators.joins import lookup_join

DIMENSIONS = ("source", "lang", "topic")
# Without own targets a value's share of tokens is raised to this power, so that large ones shrink towards small ones.
TEMPER = 0.7
ROUNDS = 8
SEED = "mix"
# NULL is a value of its own, counted with this one.
NO_VALUE = "(none)"
# Texts that are mostly table cells, capitals or symbols, or name a licence: shares of their code points (percent).
TABLE_PERCENT, CAPITALS_PERCENT, SYMBOLS_PERCENT = 2, 30, 8

_CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_SYMBOLS = "#$%&*"


def topic(text: Column) -> Column:
    """What kind of text it is, by surface form; the tables name no topic. Any other column may be given instead."""

    def percent_of(letters: str) -> Column:
        return (F.length(text) - F.length(F.translate(text, letters, ""))) * 100

    return (
        F.when(F.length(text) == 0, "prose")
        .when(percent_of("|") >= TABLE_PERCENT * F.length(text), "table")
        .when(percent_of(_CAPITALS) >= CAPITALS_PERCENT * F.length(text), "capitals")
        .when(percent_of(_SYMBOLS) >= SYMBOLS_PERCENT * F.length(text), "symbols")
        .when(text.contains("License") | text.contains("Copyright"), "legal")
        .otherwise("prose")
    )


def tokens(text: Column) -> Column:
    """Tokens of a text for the weights: four code points count as one, begun ones too."""
    return F.floor((F.length(text) + 3) / 4).cast("long")


def _targets(shares: DataFrame, of: str, given: dict[str, float] | None) -> DataFrame:
    """(value, target share): the given weights, or tempered shares; values without a given weight keep their share."""
    if given:
        pairs = F.create_map(*(F.lit(x) for pair in given.items() for x in (pair[0], float(pair[1]))))
        weight = F.coalesce(F.try_element_at(pairs, F.col(of)), F.col("share"))
    else:
        weight = F.pow(F.col("share"), F.lit(TEMPER))
    weighed = shares.select(of, weight.alias("weight"))
    total = weighed.agg(F.sum("weight")).first()[0]
    return weighed.select(of, (F.col("weight") / F.lit(total)).alias("target"))


def cell_weights(cells: DataFrame, targets: dict[str, dict[str, float]] | None = None, rounds: int = ROUNDS) -> DataFrame:
    """``cells`` (source, lang, topic, tokens) with ``weight``; a cell without tokens keeps weight 1.

    ``targets`` has the weights of values by dimension. Weighted tokens sum to all tokens after each scaling. Each
    round is written and read back, its sums are taken beside the cells without a join; of the cells only totals, single
    numbers, reach the driver.
    """
    cells = stored(cells.withColumn("weight", F.lit(1.0)), "cells")
    total = float(cells.agg(F.sum("tokens")).first()[0] or 0)
    wanted = {}
    for of in DIMENSIONS:
        sums = cells.groupBy(of).agg(F.sum("tokens").alias("own"))
        shares = sums.where(F.col("own") > 0).select(of, (F.col("own") / F.lit(total)).alias("share"))
        wanted[of] = stored(_targets(shares, of, (targets or {}).get(of)), "targets")
    for of in DIMENSIONS:
        cells = cells.join(wanted[of].withColumnRenamed("target", f"{of}_target"), of, "left")
    cells = stored(cells, "cells")
    for _ in range(rounds):
        for of in DIMENSIONS:
            own = F.sum(F.col("tokens") * F.col("weight")).over(Window.partitionBy(of))
            factor = F.col(f"{of}_target") * F.lit(total) / own
            cells = cells.withColumn("weight", F.col("weight") * F.coalesce(factor, F.lit(1.0)))
        cells = stored(cells, "cells")
    return cells.select(*DIMENSIONS, "tokens", "weight")


def chance(doc_id: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) that depends on the id alone; rows of one id share it."""
    digest = F.md5(F.concat(F.lit(seed), F.lit(":"), F.coalesce(doc_id.cast("string"), F.lit("")))).substr(1, 13)
    return F.conv(digest, 16, 10).cast("double") / float(1 << 52)


def probabilities(docs: DataFrame, topic_of: Column | None = None, targets: dict[str, dict[str, float]] | None = None,
                  rounds: int = ROUNDS, seed: str = SEED) -> DataFrame:
    """``docs`` with ``mix_topic``, ``probability`` and ``sampled``.

    The weight of a document's cell over the largest weight is its probability, so no target is cut off and the
    expected shares of tokens in the sample are the fitted ones. NULL and empty texts have no tokens; a cell of such
    texts only counts as average (weight 1). NULL sources and languages are a value of their own. Rows of one id are
    sampled together; ties don't arise; an empty table stays empty. Columns named like the new ones are replaced.
    """
    names = ("mix_topic", "probability", "sampled")
    kept = [c for c in docs.columns if c.lower() not in names]
    text = text_of("text")
    keys = {of: own_name(docs, f"_{of}") for of in DIMENSIONS}
    rows = docs.select(*(F.col(f"`{c}`") for c in kept)).withColumns({
        keys["source"]: F.coalesce(F.col("source"), F.lit(NO_VALUE)),
        keys["lang"]: F.coalesce(F.col("lang"), F.lit(NO_VALUE)),
        keys["topic"]: F.coalesce(topic_of if topic_of is not None else topic(text), F.lit(NO_VALUE)),
    })
    cells = rows.groupBy(*(F.col(k).alias(of) for of, k in keys.items())).agg(F.sum(tokens(text)).alias("tokens"))
    fitted = cell_weights(cells, targets, rounds)
    most = F.lit(fitted.agg(F.max("weight")).first()[0]).cast("double")
    chances = stored(fitted.select(
        *(F.col(of).alias(k) for of, k in keys.items()), F.round(F.col("weight") / most, 9).alias("probability")),
        "chances")
    out = lookup_join(rows, chances, list(keys.values()))
    return out.select(
        *(F.col(f"`{c}`") for c in kept), F.col(keys["topic"]).alias("mix_topic"), "probability",
        (chance(F.col("doc_id"), seed) < F.col("probability")).alias("sampled"))


def sample(docs: DataFrame, targets: dict[str, dict[str, float]] | None = None) -> DataFrame:
    """The sampled documents."""
    return probabilities(docs, targets=targets).where("sampled").select(*(F.col(f"`{c}`") for c in docs.columns))


def digests(docs: DataFrame) -> DataFrame:
    """Per document: its tokens and cell, its probability and whether it is sampled."""
    return probabilities(docs.select("doc_id", "source", "lang", "text")).select(
        "doc_id", "source", "lang", F.col("mix_topic").alias("topic"), tokens(text_of("text")).alias("n_tokens"),
        "probability", F.col("sampled").cast("int").alias("sampled"))


def _round_sql(n: int, of: str, step: int) -> str:
    """One scaling in SQL: from table c{n} to c{n + 1}."""
    others = ", ".join(f"c.{x}" for x in DIMENSIONS)
    return f"""c{n + 1} AS (
  SELECT {others}, c.tokens, c.weight * coalesce(f.factor, 1) AS weight FROM c{n} c LEFT JOIN (
    SELECT s.{of}, t.target * (SELECT sum(tokens * weight) FROM c{n}) / s.own AS factor
    FROM (SELECT {of}, sum(tokens * weight) AS own FROM c{n} GROUP BY {of}) s JOIN t{step} t ON s.{of} = t.{of}
  ) f ON c.{of} = f.{of}
)"""


def sql(rounds: int = ROUNDS) -> str:
    """``digests`` with default targets, in SQL."""

    def percent(letters: str) -> str:
        return f"(length(t) - length(translate(t, '{letters}', ''))) * 100"

    parts = [f"""d AS (
  SELECT doc_id, source, lang, t, (length(t) + 3) // 4 AS n_tokens, coalesce(source, '{NO_VALUE}') AS s_key,
    coalesce(lang, '{NO_VALUE}') AS l_key,
    CASE WHEN length(t) = 0 THEN 'prose' WHEN {percent('|')} >= {TABLE_PERCENT} * length(t) THEN 'table'
      WHEN {percent(_CAPITALS)} >= {CAPITALS_PERCENT} * length(t) THEN 'capitals'
      WHEN {percent(_SYMBOLS)} >= {SYMBOLS_PERCENT} * length(t) THEN 'symbols'
      WHEN contains(t, 'License') OR contains(t, 'Copyright') THEN 'legal' ELSE 'prose' END AS topic
  FROM (SELECT *, coalesce(text, '') AS t FROM documents) x
), c0 AS MATERIALIZED (
  SELECT s_key AS source, l_key AS lang, topic, CAST(sum(n_tokens) AS DOUBLE) AS tokens, CAST(1 AS DOUBLE) AS weight
  FROM d GROUP BY ALL
)"""]
    for i, of in enumerate(DIMENSIONS):
        parts.append(f"""t{i} AS (
  SELECT {of}, pow(own / (SELECT sum(tokens) FROM c0), {TEMPER}) / sum(pow(own / (SELECT sum(tokens) FROM c0), {TEMPER}))
    OVER () AS target
  FROM (SELECT {of}, sum(tokens) AS own FROM c0 GROUP BY {of}) x WHERE own > 0
)""")
    n = 0
    for _ in range(rounds):
        for i, of in enumerate(DIMENSIONS):
            parts.append(_round_sql(n, of, i).replace(" AS (", " AS MATERIALIZED (", 1))
            n += 1
    return "WITH " + ", ".join(parts) + f"""
SELECT doc_id, d.source, d.lang, d.topic, n_tokens, p AS probability,
  CAST(CAST('0x' || substr(md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13) AS BIGINT)
    / {float(1 << 52)} < p AS INTEGER) AS sampled
FROM d JOIN (
  SELECT source, lang, topic, round(weight / max(weight) OVER (), 9) AS p FROM c{n}
) w ON d.s_key = w.source AND d.l_key = w.lang AND d.topic = w.topic"""
