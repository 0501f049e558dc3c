"""What the text operators share: reading the given tables, and cutting lineage in the shared folder."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.session import new_table_path

# Code points that separate words and may surround a line: space and the five controls from tab to carriage return.
BLANKS = " \t\n\x0b\x0c\r"
BLANK_BYTES = BLANKS.encode()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows of ``df`` written to the folder all executors share, and read again: lineage ends there."""
    path = new_table_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


# Per application the folder of its package file, which the driver serves until it ends.
_shipped: dict[str, tempfile.TemporaryDirectory] = {}


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once per application: their Python may not have it on its path."""
    application = spark.sparkContext.applicationId
    if application in _shipped:
        return
    package, folder = Path(__file__).parents[1], tempfile.TemporaryDirectory(prefix="package-")
    path = f"{folder.name}/{package.name}.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
        for file in sorted(package.rglob("*.py")):
            out.write(file, file.relative_to(package.parent))
    spark.sparkContext.addPyFile(path)
    _shipped[application] = folder


def own_name(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't use, so that extra columns of the caller never clash."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"{name}_"
    return name


def text_of(column: str):
    """A text column with NULL read as empty."""
    return F.coalesce(F.col(f"`{column}`"), F.lit(""))
