"""Name checks against the taxonomy and conservation lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.operators.copies import COPIES, repeated
from tidewatch.operators.joins import lookup_join


def validate_taxa(occurrences: DataFrame, taxonomy: DataFrame, mode: str = "inner") -> DataFrame:
    """Occurrences whose species is a taxonomy name.

    ``inner`` repeats an occurrence for every taxonomy row of its name; ``counted`` keeps it once with the number of
    those rows in ``COPIES``; ``semi`` keeps it once. What is joined and measured is each name once, however often the
    taxonomy repeats it.
    """
    names = taxonomy.select(F.col("scientificName").alias("species"))
    if mode in ("inner", "counted"):
        counts = names.groupBy("species").agg(F.count(F.lit(1)).alias(COPIES))
        counted = lookup_join(occurrences, counts, "species", "inner").select(*occurrences.columns, COPIES)
        return counted if mode == "counted" else repeated(counted)
    if mode == "semi":
        return lookup_join(occurrences, names.distinct(), "species", "left_semi")
    raise ValueError(f"mode must be 'inner', 'counted' or 'semi', not {mode!r}")


def _flag(species: DataFrame, listed: DataFrame, name: str) -> DataFrame:
    names = listed.select(F.col("scientificName").alias("species")).distinct().withColumn(name, F.lit(True))
    return lookup_join(species, names, "species", "left", size_of=listed, hot_keys=False).withColumn(
        name, F.coalesce(F.col(name), F.lit(False))
    )


def classify_species(species: DataFrame, redlist: DataFrame, invasive: DataFrame) -> DataFrame:
    """Add is_endangered, is_invasive and species_type; endangered wins over invasive."""
    flagged = _flag(_flag(species, redlist, "is_endangered"), invasive, "is_invasive")
    return flagged.withColumn(
        "species_type",
        F.when(F.col("is_endangered"), "endangered").when(F.col("is_invasive"), "invasive").otherwise("normal"),
    )
