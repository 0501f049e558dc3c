"""Search from stored postings: which species have a word, or three letters in a row, in one of their names.

A search reads the postings of its words or letters, keeps the species that all of them name, and checks those rows. The
postings are clustered by key, so a search opens the few files its keys lie in.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.text import has_all_tokens, tokens
from tidewatch.plans import serving
from tidewatch.sources.writers import write_table

# A piece is so many letters; a search text without so many in a row, apart from its wildcards, has none.
PIECE = 3
NAMES = ("species", "common_name")


def pieces(name):
    """All runs of ``PIECE`` letters of a lower-cased name, once each."""
    low = F.lower(name)
    last = F.greatest(F.length(low) - (PIECE - 1), F.lit(0))
    return F.array_distinct(F.when(last > 0, F.transform(
        F.sequence(F.lit(1), last), lambda at: F.substring(low, at, F.lit(PIECE)))).otherwise(F.array().cast("array<string>")))


def postings(table: DataFrame) -> DataFrame:
    """(kind, key, species): ``word`` of the common name, ``piece`` of the scientific or the common name.

    Which name a piece is from is kept in ``kind`` (``piece0``, ``piece1``), as a match lies in one name. A NULL name
    has none.
    """
    names = table.select(*NAMES).distinct()
    keys = [names.select(F.lit("word").alias("kind"), F.explode(F.array_distinct(tokens(F.col("common_name")))).alias("key"), "species")]
    for i, name in enumerate(NAMES):
        keys.append(names.select(F.lit(f"piece{i}").alias("kind"), F.explode(pieces(F.col(name))).alias("key"), "species"))
    return keys[0].unionByName(keys[1]).unionByName(keys[2]).distinct()


def write_postings(table: DataFrame, path: str, files: int | None = None) -> DataFrame:
    """Store the postings of a table by key and return them, read back."""
    write_table(postings(table), path, cluster_by=["kind", "key"], partitions=files)
    return table.sparkSession.read.parquet(path)


def _having(stored: DataFrame, kind: str, keys: list[str]) -> DataFrame:
    """The species that have all the keys."""
    own = stored.where((F.col("kind") == kind) & F.col("key").isin(*keys))
    return own.groupBy("species").agg(F.count_distinct("key").alias("n")).where(F.col("n") == len(keys)).select("species")


def search_pieces(table: DataFrame, q: str, escape: bool = False) -> list[str] | None:
    """The pieces that a matching name must have, as Spark lower-cases them; None if the text has no piece."""
    runs = [q] if escape else re.split("[%_]", q)
    spark = table.sparkSession
    low = spark.createDataFrame([(r,) for r in runs], "run string").select(F.explode(pieces(F.col("run"))).alias("key"))
    found = sorted({r.key for r in low.collect()})
    return found or None


def matching_species(table: DataFrame, stored: DataFrame, q: str = "", species_type: str = "all", escape: bool = False) -> DataFrame:
    """As ``serving.matching_species``, from the postings of the same table; texts without a piece scan the table."""
    keys = search_pieces(table, q, escape)
    if keys is None:
        return serving.matching_species(table, q, species_type, escape)
    found = _having(stored, "piece0", keys).unionByName(_having(stored, "piece1", keys)).distinct()
    return serving.matching_species(table.join(found, "species", "left_semi"), q, species_type, escape)


def token_matches(table: DataFrame, stored: DataFrame, text: str) -> DataFrame:
    """Rows whose common name has every word of the text, from the postings; a text without words matches all names."""
    row = table.sparkSession.createDataFrame([(text,)], "text string").select(tokens(F.col("text")).alias("words")).first()
    rows = table.where(has_all_tokens(F.col("common_name"), text))
    if not row.words:
        return rows
    return rows.join(_having(stored, "word", sorted(set(row.words))), "species", "left_semi")
