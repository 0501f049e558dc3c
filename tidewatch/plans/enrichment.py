"""Enrichment of species with names, texts and images, from replies that were landed as tables.

NULL means not tried, '' means tried and nothing found. Work list -> lookups needed -> replies read ->
resolved rows -> upsert. Nothing here fetches anything.
"""

from __future__ import annotations

import math

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewatch.functions.text import blank_to_null
from tidewatch.functions.urls import thumbnail_url
from tidewatch.operators.joins import lookup_join
from tidewatch.session import new_table_path
from tidewatch.sources import schemas, versions

FIELDS = ("common_name", "description", "image_url")

# Rows per batch, in production and in development, and names per image lookup.
BATCH_ROWS = 500
DEV_BATCH_ROWS = 50
IMAGE_GROUP_NAMES = 50
# Batches that are committed together at least, and units of a run at most. A unit has at least so many files, and more
# where one would hold more rows than this.
UNIT_BATCHES, MOST_UNITS = 20, 64
UNIT_FILES, FILE_ROWS = 4, 50_000
# The enrichment table is split into so many buckets by a hash of the species.
BUCKETS = 64


def _any(columns):
    result = columns[0]
    for column in columns[1:]:
        result = result | column
    return result


def new_species(species_table: DataFrame, enrichment: DataFrame) -> DataFrame:
    """Species without an enrichment row, as empty work rows."""
    unknown = lookup_join(species_table.select("species"), enrichment.select("species").distinct(), "species",
                          "left_anti", size_of=enrichment, hot_keys=False)
    empty = [F.lit(None).cast("string").alias(name) for name in FIELDS]
    return unknown.select("species", *empty, F.lit(True).alias("is_new"))


def partial_rows(enrichment: DataFrame) -> DataFrame:
    """Enrichment rows with some fields tried and some not. A row with no field tried is not among them."""
    missing = _any([F.col(name).isNull() for name in FIELDS])
    tried = _any([F.col(name).isNotNull() for name in FIELDS])
    return enrichment.where(missing & tried).select("species", *FIELDS, F.lit(False).alias("is_new"))


def work_list(species_table: DataFrame, enrichment: DataFrame, new_only: bool = False) -> DataFrame:
    """Rows to enrich: never-seen species and, unless ``new_only``, partly tried rows."""
    unseen = new_species(species_table, enrichment)
    return unseen if new_only else partial_rows(enrichment).unionByName(unseen)


def remaining(work: DataFrame, completed: DataFrame) -> DataFrame:
    """Work whose species is not completed yet."""
    return lookup_join(work, completed.select("species").distinct(), "species", "left_anti", size_of=completed,
                       hot_keys=False)


def assign_batches(work: DataFrame, batch_rows: int = BATCH_ROWS, total: int | None = None) -> DataFrame:
    """Add a ``batch_id`` such that batches hold about ``batch_rows`` rows each; the same name, the same batch."""
    batches = max(1, math.ceil((work.count() if total is None else total) / batch_rows))
    return work.withColumn("batch_id", _batch(batches))


def _batch(batches: int):
    """The batch of a species."""
    return F.pmod(F.xxhash64("species"), F.lit(batches))


def image_groups(needs: DataFrame, batched: DataFrame) -> DataFrame:
    """The fallback lookups as groups of ``IMAGE_GROUP_NAMES`` names: (batch_id, image_group, names).

    ``needs`` marks the species that need one, ``batched`` has their batch. Groups don't cross batches, so a group is
    ranked within the few hundred names of a batch.
    """
    wanted = batched.select("batch_id", "species").join(
        needs.where("needs_fallback").select("species").distinct(), "species").distinct()
    place = F.row_number().over(Window.partitionBy("batch_id").orderBy("species"))
    group = F.floor((place - 1) / IMAGE_GROUP_NAMES).cast("int")
    return wanted.select("batch_id", "species", group.alias("image_group")).groupBy("batch_id", "image_group").agg(
        F.array_sort(F.collect_list("species")).alias("names"))


def extract_common_name(replies: DataFrame) -> DataFrame:
    """First English name of each species whose match is a species with a key: (species, common_name).

    Should a reply have been landed twice, the smaller name is kept, so that a species has one row.
    """
    match = F.from_json("match_json", schemas.NAME_MATCH)
    english = F.filter(F.from_json("names_json", schemas.NAME_LIST)["results"], lambda r: r.language == "eng")
    named = replies.where((F.coalesce(match["usageKey"], F.lit(0)) != 0) & (match["rank"] == "SPECIES")).select(
        "species", F.get(english, F.lit(0))["vernacularName"].alias("common_name")
    )
    return named.where("common_name IS NOT NULL").groupBy("species").agg(F.min("common_name").alias("common_name"))


def extract_summary(replies: DataFrame) -> DataFrame:
    """Text and image of each species that has either: (species, description, image_url).

    Should replies of a species have been landed twice, one with both wins over one with a text, that over one with an
    image, and of equals the smallest: what is missing never wins.
    """
    reply = F.from_json("json", schemas.SUMMARY)
    found = replies.select(
        "species", reply["extract"].alias("description"), reply["originalimage"]["source"].alias("image_url")
    )
    found = found.where("description IS NOT NULL OR image_url IS NOT NULL")
    lacks = F.col("description").isNull().cast("int") * 2 + F.col("image_url").isNull().cast("int")
    one = found.groupBy("species").agg(F.min(F.struct(lacks, "description", "image_url")).alias("one"))
    return one.select("species", "one.description", "one.image_url")


def extract_fallback_image(replies: DataFrame, width: int = 800) -> DataFrame:
    """Thumbnail of the first listed image of each name: (species, image_url)."""
    bindings = F.from_json("json", schemas.IMAGE_BINDINGS)["results"]["bindings"]
    listed = replies.select(F.posexplode(bindings).alias("position", "b")).select(
        "position", F.col("b.scientificName.value").alias("species"), F.col("b.image.value").alias("url")
    )
    first = (
        listed.where("species IS NOT NULL AND url <> ''")
        .groupBy("species")
        .agg(F.min(F.struct("position", "url")).alias("first"))
    )
    return first.select("species", thumbnail_url(F.col("first.url"), width).alias("image_url"))


def plan_lookups(work: DataFrame, summaries: DataFrame) -> DataFrame:
    """Which lookups each work row needs; the image fallback only where the summary has no image either."""
    with_image = summaries.where("image_url IS NOT NULL").select("species").distinct()
    marked = work.join(with_image.withColumn("_has", F.lit(True)), "species", "left")
    no_image = F.col("image_url").isNull()
    return marked.select(
        "species",
        F.col("common_name").isNull().alias("needs_name"),
        (F.col("description").isNull() | no_image).alias("needs_summary"),
        (no_image & F.col("_has").isNull()).alias("needs_fallback"),
    )


def resolve_enrichment(
    work: DataFrame, names: DataFrame, summaries: DataFrame, images: DataFrame
) -> DataFrame:
    """Work rows with the fields the lookups found.

    A found value that is not blank wins over the old one. On retried rows what is still missing becomes '',
    so that they are not tried again; new rows keep NULL.
    """
    # Replies have one row per species; adaptive execution measures them and chooses how to join.
    looked_up = work
    for reply, renamed in (
        (names, {"common_name": "_name"}),
        (summaries, {"description": "_text", "image_url": "_image"}),
        (images, {"image_url": "_fallback"}),
    ):
        looked_up = looked_up.join(reply.withColumnsRenamed(renamed), "species", "left")
    wants_name = F.col("common_name").isNull()
    wants_text = F.col("description").isNull() | F.col("image_url").isNull()
    wants_fallback = F.col("image_url").isNull() & F.col("_image").isNull()
    name = F.coalesce(blank_to_null(F.when(wants_name, F.col("_name"))), F.col("common_name"))
    text = F.coalesce(blank_to_null(F.when(wants_text, F.col("_text"))), F.col("description"))
    image = F.coalesce(
        blank_to_null(F.when(wants_text, F.col("_image"))),
        blank_to_null(F.when(wants_fallback, F.col("_fallback"))),
        F.col("image_url"),
    )

    def settled(value, field):
        return F.when(F.col("is_new"), value).otherwise(F.coalesce(value, F.lit(""))).alias(field)

    return looked_up.select(
        "species", settled(name, "common_name"), settled(text, "description"), settled(image, "image_url"), "is_new"
    )


def repeated_keys(enrichment: DataFrame) -> DataFrame:
    """Species with more than one row."""
    return enrichment.groupBy("species").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")


def dedup_enrichment(enrichment: DataFrame) -> DataFrame:
    """Rows that are equal in every column, once."""
    return enrichment.distinct()


def merge_enrichment(target: DataFrame, staged: DataFrame) -> DataFrame:
    """The new version of the enrichment table: staged fields overwrite unless NULL, unknown species are added.

    ``staged`` should be stored rows, as it is read twice. Fails if the staged rows name a species twice, since no single row could win.
    """
    repeated = repeated_keys(staged.where("species IS NOT NULL")).select("species").first()
    if repeated is not None:
        raise ValueError(f"more than one staged row for species {repeated.species!r}")
    both = target.alias("t").join(staged.alias("s"), F.col("t.species") == F.col("s.species"), "full_outer")
    return both.select(
        *(F.coalesce(F.col(f"s.{name}"), F.col(f"t.{name}")).alias(name) for name in ("species", *FIELDS))
    )


def coverage_counts(species_table: DataFrame, enrichment: DataFrame) -> DataFrame:
    """One row: species in all, rows with every field found, rows with any field found."""
    found = [blank_to_null(F.col(name)).isNotNull() for name in FIELDS]
    zero = F.lit(0).cast("bigint")
    tallies = enrichment.agg(
        zero.alias("total_species"),
        F.count_if(found[0] & found[1] & found[2]).alias("fully_enriched"),
        F.count_if(_any(found)).alias("with_any_data"),
    )
    total = species_table.agg(
        F.count(F.lit(1)).alias("total_species"), zero.alias("fully_enriched"), zero.alias("with_any_data")
    )
    return total.unionByName(tallies).agg(*(F.sum(name).alias(name) for name in total.columns))


def coverage_shares(rows: DataFrame) -> DataFrame:
    """Share of rows with each field found, in percent, and the tallies behind them."""
    found = {name: blank_to_null(F.col(name)).isNotNull() for name in FIELDS}
    return rows.agg(
        F.count(F.lit(1)).alias("rows"),
        *(F.count_if(test).alias(f"with_{name}") for name, test in found.items()),
        F.count_if(_any(list(found.values()))).alias("with_any"),
        *(F.avg(F.when(test, 100.0).otherwise(0.0)).alias(f"{name}_percent") for name, test in found.items()),
    )


def completed_rows(spark: SparkSession, path: str) -> DataFrame:
    """Rows stored by units that are done; none if the folder does not exist."""
    return _read_or_empty(spark, path, f"{schemas.ENRICHMENT}, is_new boolean, batch_id bigint, unit int")


def _read_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def _stored(df: DataFrame, name: str, by: str | None = None, files: int = 1) -> DataFrame:
    """Rows stored, on request in folders by a column, each in up to ``files`` files."""
    path = new_table_path(df.sparkSession, name)
    (df.repartition(by, _part(files)).write.partitionBy(by) if by else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _part(parts: int):
    """A part of a unit, by another hash than the batch."""
    return F.pmod(F.xxhash64("species", F.lit("part")), F.lit(parts))


def unit_files(rows: int, units: int) -> int:
    """Files of a unit, and tasks that write it: they grow with the rows."""
    return max(UNIT_FILES, math.ceil(rows / max(1, units) / FILE_ROWS))


def enrich_incremental(
    spark: SparkSession,
    work: DataFrame,
    names: DataFrame,
    summaries: DataFrame,
    images: DataFrame,
    progress: str,
    batch_rows: int = BATCH_ROWS,
    unit_batches: int = UNIT_BATCHES,
) -> DataFrame:
    """Resolve the work that is not in the progress folder yet, add it there, and return all completed rows.

    Batches are resolved in units of at least ``unit_batches``, at most ``MOST_UNITS`` units. Each unit is one job that
    commits its own folder: units that are done stay when a later one fails, and the next run resolves the rest. Work and
    replies are stored by unit, so a unit reads its share of them only; a unit is as many tasks as its rows need.
    """
    done = completed_rows(spark, progress)
    last = done.agg(F.max("batch_id").alias("batch"), F.max("unit").alias("unit")).first()
    first_batch, first_unit = (0 if x is None else x + 1 for x in (last.batch, last.unit))
    todo = _stored(remaining(work, done), "todo")
    total = todo.count()
    if not total:
        return completed_rows(spark, progress)
    batches = math.ceil(total / batch_rows)
    per_unit = max(unit_batches, math.ceil(batches / MOST_UNITS))
    batch, units = _batch(batches), math.ceil(batches / per_unit)
    files = unit_files(total, units)

    def by_unit(df: DataFrame, name: str) -> DataFrame:
        return _stored(df.withColumn("unit", F.floor(batch / per_unit).cast("int")), name, by="unit", files=files)

    todo = by_unit(todo, "work_by_unit")
    replies = [by_unit(x, "replies_by_unit") for x in (names, summaries, images)]
    for unit in range(units):
        own = [x.where(F.col("unit") == unit).drop("unit") for x in (todo, *replies)]
        resolved = resolve_enrichment(*own).withColumn("batch_id", batch + first_batch)
        resolved.repartition(files).write.mode("overwrite").parquet(f"{progress}/unit={first_unit + unit}")
    return completed_rows(spark, progress)


def current_version(spark: SparkSession, folder: str) -> tuple[DataFrame, int]:
    """The newest complete version of the enrichment table and its number; 0 and no rows before the first."""
    every = _read_or_empty(spark, folder, f"{schemas.ENRICHMENT}, version int")
    number = every.agg(F.max("version")).first()[0] or 0
    return every.where(F.col("version") == number).drop("version"), number


def write_version(table: DataFrame, folder: str, number: int) -> None:
    """Store a version beside the others; a write that fails leaves no part of it, so the one before stays current."""
    table.write.mode("overwrite").parquet(f"{folder}/version={number}")


def run_enrichment(
    spark: SparkSession,
    species_table: DataFrame,
    folder: str,
    progress: str,
    replies: tuple[DataFrame, DataFrame, DataFrame] | None = None,
    new_only: bool = False,
    batch_rows: int = BATCH_ROWS,
) -> DataFrame:
    """One enrichment run: work list, resolved units, upsert as a new version. Returns coverage before and after.

    ``replies`` are landed name, summary and image replies; without them only the progress of earlier runs is put into
    the table. Progress belongs to the version it builds on, so what is in the table is never read as progress again.
    Without any progress no version is written.
    """
    target, number = current_version(spark, folder)
    units = f"{progress}/onto={number}"
    before = coverage_counts(species_table, target).withColumn("moment", F.lit("before"))
    if replies is not None:
        found = (extract_common_name(replies[0]), extract_summary(replies[1]), extract_fallback_image(replies[2]))
        enrich_incremental(spark, work_list(species_table, target, new_only), *found, units, batch_rows)
    staged = completed_rows(spark, units).select("species", *FIELDS)
    if not staged.isEmpty():
        write_version(merge_enrichment(target, staged), folder, number + 1)
    after = coverage_counts(species_table, current_version(spark, folder)[0]).withColumn("moment", F.lit("after"))
    return before.unionByName(after)


def upsert_buckets(spark: SparkSession, folder: str, staged: DataFrame, buckets: int = BUCKETS) -> int:
    """Put staged rows into a table of buckets and return the number of the new version.

    Only buckets that a staged species falls in are read and written; the new version lists the old folders of all
    others, whose files stay as they are. The same ``buckets`` must be used for every upsert of a folder. Without staged
    rows no version is written. ``staged`` should be stored rows, as it is read twice.
    """
    bucket = F.pmod(F.xxhash64("species"), F.lit(buckets)).cast("int")
    number, parts = versions.current_parts(spark, folder)
    # At most one row per bucket.
    touched = sorted(r.bucket for r in staged.select(bucket.alias("bucket")).distinct().collect())
    if not touched:
        return number
    target = versions.read_parts(spark, [parts[str(b)] for b in touched if str(b) in parts], schemas.ENRICHMENT)
    merged = merge_enrichment(target, staged.select("species", *FIELDS)).withColumn("bucket", bucket)
    path = versions.new_data_path(folder, number + 1)
    merged.repartition(len(touched), "bucket").write.partitionBy("bucket").parquet(path)
    versions.commit(spark, folder, number + 1, parts | {str(b): f"{path}/bucket={b}" for b in touched})
    return number + 1


def read_buckets(spark: SparkSession, folder: str) -> DataFrame:
    """The current version of a table of buckets."""
    return versions.read_current(spark, folder, schemas.ENRICHMENT)
