"""Document fingerprints of closed syncmers, in column expressions only.

A run of ``K`` words is an anchor where the least of its inner runs of ``S`` words, by hash, is the first or the last:
whether it is chosen depends on its own words alone, so equal passages have equal anchors wherever they stand.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.common import text_of

# Words of an anchor and of the inner runs that choose it: about half of the runs are chosen.
K, S = 5, 2
# Ranges of doc_id that are ordered apart: at least so many per shuffle partition, and one for so many bytes of text.
RANGES_PER_PARTITION, RANGE_BYTES = 2, 64 * 1024 * 1024

# Below any id, for rows without one.
_NO_ID = -(1 << 63)


def _let(value: Column, body) -> Column:
    """``body`` of ``value``, which is computed once."""
    return F.transform(F.array(value), body)[0]


def anchors(text: Column, k: int = K, s: int = S) -> Column:
    """The closed syncmers of a text in order: array of (position in words, hash).

    Words are split at space and tab to carriage return. A text of fewer than ``k`` words is one anchor at 0; a text
    without words, or NULL, has none. Repeated passages give repeated anchors.
    """
    words = F.filter(F.split(F.coalesce(text, F.lit("")), "[ \t-\r]+", -1), lambda w: w != "")
    hashes = F.transform(words, lambda w: F.xxhash64(w))
    inner, last = k - s + 1, k - s

    def inner_runs(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(w) - s), lambda i: F.xxhash64(*(w[i + j] for j in range(s))))

    def chosen(h: Column) -> Column:
        # Inner runs that cover the whole anchor, the last one ending with it.
        cover = [*range(0, last, s), last]
        every = F.transform(F.sequence(F.lit(0), F.size(h) - inner), lambda i: F.when(
            F.least(h[i], h[i + last]) <= F.least(*(h[i + j] for j in range(1, max(2, last)))),
            F.struct(i.alias("position"), F.shiftright(F.xxhash64(*(h[i + j] for j in cover)), 32).cast("int").alias("hash"))))
        return F.filter(every, lambda x: x.isNotNull())

    def of(w: Column) -> Column:
        whole = F.aggregate(w, F.lit(0).cast("long"), lambda a, x: F.xxhash64(a, x))
        one = F.array(F.struct(F.lit(0).alias("position"), F.shiftright(whole, 32).cast("int").alias("hash")))
        return F.when(F.size(w) >= k, _let(inner_runs(w), chosen)).when(F.size(w) > 0, one).otherwise(F.slice(one, 1, 0))

    return _let(hashes, of)


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two arrays of anchor hashes, 0 to 1; 1 where both are empty."""
    common = F.size(F.array_intersect(a, b))
    union = F.size(F.array_distinct(a)) + F.size(F.array_distinct(b)) - common
    return F.when(union > 0, common / union).otherwise(F.lit(1.0))


def printed(hashes: Column) -> Column:
    """A fingerprint as text: the anchors in order, 8 hexadecimal digits each."""
    return F.array_join(F.transform(hashes, lambda h: F.lpad(F.lower(F.hex(h.bitwiseAND(F.lit(0xFFFFFFFF)))), 8, "0")), "")


def fingerprints(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with a column ``anchors``, see ``anchors``.

    Every row is read by itself, whole, however long: repeated rows have equal anchors, an empty table stays empty. A column of the
    name ``anchors`` is replaced, all others pass untouched.
    """
    return docs.withColumn("anchors", anchors(F.col(f"`{text}`")))


def _in_id_order(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``text`` and ``next_text``, that of the next row by doc_id; after the last comes the first.

    Ids are cut into ranges at their quantiles, as many as the bytes of the texts need; a range of one id only, such as
    that of all rows without id, is cut further by a hash of the text. Each range is sorted by one task of its own, and
    the first row of the next range is added to it. Only bounds, bytes and first ids of the ranges reach the driver.
    Rows of one id follow each other by that hash, then the text; rows without id come first.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", text_of("text").alias("text"),
                       F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("_key"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = max(RANGES_PER_PARTITION * max(4, int(spark.conf.get("spark.sql.shuffle.partitions"))), ceil(total / RANGE_BYTES))
    cuts = F.array(*(F.lit(i / ranges) for i in range(1, ranges)))
    bounds = sorted(set(rows.agg(F.percentile_approx("_key", cuts, 100 * ranges)).first()[0] or []))
    # Bounds of bounds keep the search for a row's range short.
    step = max(1, round(len(bounds) ** 0.5))
    coarse = F.array(*(F.lit(b) for b in bounds[step - 1::step])) if bounds else F.array().cast("array<long>")
    fine = F.array(*(F.lit(b) for b in bounds)) if bounds else F.array().cast("array<long>")
    before = F.size(F.filter(coarse, lambda b: b < F.col("_key"))) * step
    within = F.size(F.filter(F.slice(fine, before + 1, step), lambda b: b < F.col("_key")))
    rows = rows.withColumn("_range", before + within)
    sizes = rows.groupBy("_range").agg(
        F.sum(F.octet_length("text")).alias("bytes"), (F.min("_key") == F.max("_key")).alias("one")).collect()
    if not sizes:
        return rows.select("doc_id", "text", F.col("text").alias("next_text"))
    # Range and number of parts, with the number of parts before it.
    parts, place = [], 0
    for r in sorted(sizes):
        n = ceil(r.bytes / RANGE_BYTES) if r.one and r.bytes > 2 * RANGE_BYTES else 1
        parts.append((r._range, n, place))
        place += n
    hashed = F.xxhash64("text")
    rows = rows.withColumn("_hash", hashed).join(
        F.broadcast(spark.createDataFrame(parts, "_range int, _parts int, _place int")), "_range")
    inner = F.least(F.floor((F.col("_hash") / float(1 << 64) + 0.5) * F.col("_parts")), F.col("_parts") - 1)
    rows = rows.select("doc_id", "text", "_key", "_hash", (F.col("_place") + inner).cast("int").alias("_part"))
    firsts = sorted((r._part, r.first._key, r.first._hash) for r in rows.groupBy("_part").agg(
        F.min(F.struct("_key", "_hash")).alias("first")).collect())
    guests = spark.createDataFrame(
        [(key, h, firsts[i - 1][0]) for i, (_, key, h) in enumerate(firsts)], "_key long, _hash long, _of int")
    guest_rows = rows.drop("_part").join(F.broadcast(guests), ["_key", "_hash"]).groupBy("_of").agg(
        F.min("text").alias("text")).select(
        F.lit(None).cast(docs.schema["doc_id"].dataType).alias("doc_id"), "text", F.lit(0).cast("long").alias("_key"),
        F.lit(0).cast("long").alias("_hash"), F.col("_of").alias("_part"), F.lit(True).alias("_guest"))
    every = rows.withColumn("_guest", F.lit(False)).unionByName(guest_rows)
    order = Window.partitionBy("_part").orderBy("_guest", "_key", "_hash", "text")
    return every.repartitionById(place, F.col("_part")).withColumn("next_text", F.lead("text").over(order)).where(
        ~F.col("_guest")).drop("_key", "_hash", "_part", "_guest")


def digests(docs: DataFrame) -> DataFrame:
    """Per row: its fingerprint, that of its edited text, and how like it these and the next document's are.

    The edited text has the last half of the code points replaced by as many from the start of the next text. NULL
    texts are read as empty, very long ones whole; rows without id come first, and rows of one id in the order of a hash
    of their texts. Repeated rows follow each other. Columns but ``doc_id`` and ``text`` are not looked at, so none
    clashes; an empty table gives none.
    """
    row = _in_id_order(docs).withColumn("n_chars", F.length("text"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = F.concat(F.col("text").substr(F.lit(1), F.col("n_chars") - half), F.col("next_text").substr(F.lit(1), half))
    row = row.withColumn("edited", edited)
    marks = row.select(
        "doc_id", F.col("n_chars").cast("long").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        anchors(F.col("text"))["hash"].alias("own"), anchors(F.col("edited"))["hash"].alias("changed"),
        anchors(F.col("next_text"))["hash"].alias("following"))
    return marks.select(
        "doc_id", "n_chars", "edited_sha256", printed(F.col("own")).alias("fingerprint"),
        printed(F.col("changed")).alias("edited_fingerprint"), likeness(F.col("own"), F.col("changed")).alias("near_edited"),
        likeness(F.col("own"), F.col("following")).alias("near_next"))
