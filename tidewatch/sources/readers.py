"""Scans of landed files. All are lazy and splittable; none lists or opens data on the driver."""

from __future__ import annotations

import logging

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.session import new_table_path
from tidewatch.sources import schemas

logger = logging.getLogger(__name__)

# The three tables the two questions are answered from (fixed values).
SERVING_TABLES = ("divesite_summary", "species_divesite_summary", "divesite_species_detail")


def read_observations(spark: SparkSession, path: str, on_error: str = "fail") -> DataFrame:
    """Observation files below a folder: nine fields of the nested record, where species and position are known.

    Only those fields and the rows that pass are read from parquet. ``on_error="skip"`` leaves unreadable and
    vanished files out, so the result may be partial; the default fails.
    """
    if on_error not in ("fail", "skip"):
        raise ValueError(f"on_error must be 'fail' or 'skip', not {on_error!r}")
    skip = str(on_error == "skip").lower()
    files = (
        spark.read.schema(schemas.OBSERVATION_FILE)
        .option("pathGlobFilter", "*.parquet")
        .option("recursiveFileLookup", "true")
        .option("ignoreCorruptFiles", skip)
        .option("ignoreMissingFiles", skip)
        .parquet(path)
    )
    return files.where(
        "interpreted.species IS NOT NULL AND interpreted.decimalLatitude IS NOT NULL"
        " AND interpreted.decimalLongitude IS NOT NULL"
    ).select(
        "interpreted.species", "interpreted.individualCount", "interpreted.eventDate", "interpreted.eventTime",
        F.col("interpreted.date_year").alias("year"), "interpreted.month", "interpreted.day",
        "interpreted.decimalLongitude", "interpreted.decimalLatitude",
    )


def skipped_files(spark: SparkSession, path: str) -> DataFrame:
    """What ``read_observations(on_error="skip")`` leaves out: (path, reason, rows_read, rows_lost).

    The files found by listing are set against the rows that their footers name and the rows that a full read of the
    nine fields returns. A file that ends early has lost rows; one without readable footer has an unknown number (NULL).
    Files without rows are read whole and not listed. Costs one more scan of the fields.
    """
    def each(what: str, *counted):
        files = spark.read.schema(schemas.OBSERVATION_FILE).option("pathGlobFilter", "*.parquet").option(
            "recursiveFileLookup", "true").option("ignoreCorruptFiles", "true").option("ignoreMissingFiles", "true").parquet(path)
        return files.groupBy(F.col("_metadata.file_path").alias("path")).agg(F.count(F.lit(1)).alias(what), *counted)

    footers = each("named")
    # Reading every field finds damage that the footer doesn't show; the test keeps the fields in the scan.
    fields = F.xxhash64(*(f"interpreted.{name.split(':')[0]}" for name in schemas.OBSERVATION_FILE.split("<")[1].rstrip(">").split(",")))
    read = each("rows_read", F.max(fields).alias("_all")).where(F.col("_all").isNotNull()).drop("_all")
    listed = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option(
        "recursiveFileLookup", "true").load(path).withColumn("path", F.col("_metadata.file_path"))
    both = listed.select("path").join(footers, "path", "left").join(read, "path", "left")
    short = both.where("named IS NULL OR coalesce(rows_read, 0) < named")
    # Only files without a row in any footer are opened whole, to tell an empty table from what is no table.
    shape = listed.join(short.where("named IS NULL").select("path"), "path", "left_semi").select(
        "path", (F.col("length") >= 12).alias("long"), (F.substring("content", -4, 4) == F.lit(b"PAR1")).alias("closed"))
    reason = (F.when(F.col("named").isNotNull(), "damaged after the footer was written")
              .when(~F.col("long"), "too short for a table").when(~F.col("closed"), "no footer at the end"))
    return short.join(shape, "path", "left").select(
        "path", reason.alias("reason"), F.coalesce("rows_read", F.lit(0)).alias("rows_read"),
        (F.col("named") - F.coalesce("rows_read", F.lit(0))).alias("rows_lost")).where("reason IS NOT NULL")


def read_checklist(spark: SparkSession, path: str, columns: str, sep: str = "\t", header: bool = True) -> DataFrame:
    """Core file of an unpacked checklist archive (tab-separated, unquoted), with declared columns.

    ``columns`` is DDL for all columns in file order; name them as the file does.
    """
    return spark.read.schema(columns).csv(
        path, sep=sep, header=header, quote="", escape="", encoding="UTF-8", enforceSchema=not header,
        mode="PERMISSIVE",
    )


_REJECTED = "_rejected"


def read_checklist_with_rejects(
    spark: SparkSession, path: str, columns: str, sep: str = "\t", header: bool = True, most_rejected: float | None = None,
) -> tuple[DataFrame, DataFrame]:
    """As ``read_checklist``, but lines with too few or too many fields, or a value that is none of its type, are apart.

    Returns the rows of whole lines, and the rejected lines as (file, line). The lines are parsed once and stored, so
    that both tables and the count read what was parsed. ``most_rejected`` is the share of lines beyond which reading
    fails. An empty file has neither rows nor rejects.
    """
    lines = spark.read.schema(f"{columns}, {_REJECTED} string").csv(
        path, sep=sep, header=header, quote="", escape="", encoding="UTF-8", enforceSchema=not header,
        mode="PERMISSIVE", columnNameOfCorruptRecord=_REJECTED,
    )
    parsed, file = new_table_path(spark, "checklist_lines"), f"{_REJECTED}_file"
    lines.withColumn(file, F.col("_metadata.file_path")).write.parquet(parsed)
    stored = spark.read.parquet(parsed)
    if most_rejected is not None:
        bad, total = stored.agg(F.count(_REJECTED), F.count(F.lit(1))).first()
        if bad > most_rejected * total:
            raise ValueError(f"{bad} of {total} lines of {path} are broken")
    rejects = stored.where(F.col(_REJECTED).isNotNull()).select(F.col(file).alias("file"), F.col(_REJECTED).alias("line"))
    return stored.where(F.col(_REJECTED).isNull()).drop(_REJECTED, file), rejects


# The fields that a site must have, and the one that is never kept (fixed values).
SITE_FIELDS = {"id": "bigint", "title": "string", "latitude": "double", "longitude": "double"}
DROPPED_SITE_FIELDS = ("images",)


def build_sites_with_fields(guide_pages: DataFrame, map_pages: DataFrame, dedup: bool = False) -> DataFrame:
    """As ``build_sites``, with every other field of either side in ``fields``, name to text; ``images`` is left out.

    Pages are read as semi-structured values, so fields that no schema names survive the join. A nested value is its
    JSON text, a JSON null is no field. A field given on both sides is taken from the guide.
    """

    none = F.map_from_arrays(F.array(), F.array()).cast("map<string, string>")

    def sites_in(pages: DataFrame, values: Column, side: str) -> DataFrame:
        typed = [F.try_variant_get(F.col(side), f"$.{name}", kind).alias(f"{side}_{name}") for name, kind in SITE_FIELDS.items()]
        every = F.col(side).cast("map<string, string>")
        others = F.map_filter(every, lambda name, value: ~name.isin(*SITE_FIELDS, *DROPPED_SITE_FIELDS) & value.isNotNull())
        return pages.select(F.explode(values).alias(side)).select(*typed, F.coalesce(others, none).alias(f"{side}_fields"))

    guide = sites_in(guide_pages, F.from_json("body", "results array<variant>")["results"], "g")
    cells = sites_in(map_pages, F.from_json("body", "array<variant>"), "m")
    both = guide.join(cells, F.col("g_id") == F.col("m_id"), "full_outer")
    first, second = F.coalesce("g_fields", none), F.coalesce("m_fields", none)
    fields = F.map_concat(first, F.map_filter(second, lambda name, _: ~F.map_contains_key(first, name)))
    sites = both.select(*(F.coalesce(f"g_{name}", f"m_{name}").alias(name) for name in SITE_FIELDS), fields.alias("fields"))
    sites = sites.dropna(subset=["latitude", "longitude", "title"])
    if not dedup:
        return sites
    order = F.struct("title", "latitude", "longitude", F.to_json("fields"))
    one = sites.groupBy("id").agg(F.min_by(F.struct("title", "latitude", "longitude", "fields"), order).alias("one"))
    return one.select("id", "one.*")


def build_sites(guide_pages: DataFrame, map_pages: DataFrame, dedup: bool = False) -> DataFrame:
    """Sites from landed guide pages and map cells (JSON text in ``body``), joined on ``id``.

    Sites that lack a title or a position are dropped. Map cells overlap, so a site may repeat; ``dedup``
    keeps one row per id. A field given on both sides is taken from the guide.
    """
    guide = guide_pages.select(
        F.explode(F.from_json("body", schemas.GUIDE_PAGE)["results"]).alias("g")
    ).select("g.*")
    cells = map_pages.select(F.explode(F.from_json("body", schemas.MAP_PAGE)).alias("m")).select("m.*")
    both = guide.alias("g").join(cells.alias("m"), F.col("g.id") == F.col("m.id"), "full_outer")
    fields = ("id", "title", "latitude", "longitude")
    sites = both.select(*(F.coalesce(F.col(f"g.{name}"), F.col(f"m.{name}")).alias(name) for name in fields))
    sites = sites.dropna(subset=["latitude", "longitude", "title"])
    if not dedup:
        return sites
    one = sites.groupBy("id").agg(F.min(F.struct("title", "latitude", "longitude")).alias("one"))
    return one.select("id", "one.*")


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A stored input table, with its declared schema."""
    return spark.read.schema(schemas.STORED[name]).parquet(f"{folder.rstrip('/')}/{name}")


def open_serving(spark: SparkSession, folder: str, cache: bool = True) -> dict[str, DataFrame]:
    """The serving tables of an export, each from one file or a folder of part files, as temp views.

    A missing table is logged and left out.
    """
    opened = {}
    for name in SERVING_TABLES:
        for path in (f"{folder.rstrip('/')}/{name}.parquet", f"{folder.rstrip('/')}/{name}"):
            try:
                table = spark.read.parquet(path)
            except AnalysisException as error:
                if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                    raise
                continue
            opened[name] = table.cache() if cache else table
            opened[name].createOrReplaceTempView(name)
            break
        else:
            logger.warning("serving table not found: %s in %s", name, folder)
    return opened
