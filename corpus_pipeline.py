"""A training corpus from raw documents: each stage is one of the text operators, applied to all that the stage before kept.

Every stage but the last returns the columns it was given, with what the caller put in them; the names that operators use
for columns of their own may be among them. An empty table passes all stages. Rows are kept or dropped whole, so repeated
rows need no rule but where a stage says so.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm import bpe, lines, mixing, neardup, toxicity
from tidewatch.llm.common import own_name, table
from tidewatch.llm.queries import vocabulary_path
from tidewatch.session import new_table_path

# Documents are near-duplicates from this similarity in per cent on.
NEAR_PERCENT = 80


def _set_aside(docs: DataFrame, names: tuple[str, ...], stage: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The stage applied while the caller's columns of these names bear free ones; the caller's columns come back."""
    aside = {c: own_name(docs, f"_{c}") for c in docs.columns if c.lower() in names}
    out = stage(docs.withColumnsRenamed(aside))
    return out.select(*(F.col(f"`{aside.get(c, c)}`").alias(c) for c in docs.columns))


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity tagger, fitted to the given labels, doesn't reject.

    The whole text is scored, however long; NULL and empty texts score as texts without words. Without labels of both
    kinds all documents stay. Rows of one text go or stay together, as the score is that of the text; a score of exactly
    the threshold goes.
    """
    return toxicity.clean(docs, sf_dir)


def without_shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their texts without the lines that ten documents or more share; ``n_chars`` follows the text.

    Rows of one id are one document when lines are counted; rows without id are together one more. NULL texts become
    empty, as do texts of shared lines only; their rows stay.
    """

    def stage(rows: DataFrame) -> DataFrame:
        return lines.drop_repeated(rows).select(
            *(F.length("text").cast(rows.schema[c].dataType).alias(c) if c == "n_chars" else F.col(f"`{c}`")
              for c in rows.columns))

    return _set_aside(docs, ("n_lines", "n_dropped"), stage)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, linked at 0.8 Jaccard similarity of their five-word shingles.

    That of the smallest id stays, and rows of one id go or stay together. Texts without words, empty and NULL ones
    among them, are linked with nothing and stay, as do rows without id.
    """
    return neardup.drop_near_duplicates(docs, NEAR_PERCENT)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample in which sources, languages and topics have their target shares of tokens.

    NULL sources and languages are a value of their own, NULL and empty texts have no tokens. Rows of one id are drawn
    together, rows without id as one id. A column ``topic`` is not looked at.
    """
    return _set_aside(docs, ("mix_topic", "probability", "sampled"), mixing.sample)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with packed token ids and their number, of the whole text; NULL and empty texts have none.

    The new columns are ``ids`` and ``n_tokens``, with underscores behind where the caller has such columns.
    """
    ids, number = own_name(docs, "ids"), own_name(docs, "n_tokens")
    return bpe.encode(docs, vocabulary_path(), ids=ids).withColumn(number, (F.octet_length(ids) / 4).cast("long"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", without_toxic),
    ("line_dedup", without_shared_lines),
    ("near_duplicates", without_near_duplicates),
    ("mixing", mixed),
    ("bpe", encoded),
]

# The toxicity classifier has no SQL; tests compare each stage with a plain version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet in the shared folder and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = new_table_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
