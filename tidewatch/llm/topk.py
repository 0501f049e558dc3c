"""Exact nearest binary codes by incremental multi-index hashing.

A code is cut into segments, and an index row says which code has which value in which segment. If no segment of two
codes is within radius s, they differ in more bits than segments * (s + 1) - 1. So the radius grows until the distance
of a query's k-th verified neighbour is covered; a query that is covered stops.
"""

from __future__ import annotations

from functools import reduce
from math import ceil

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.common import stored

# Bits of a segment: about the logarithm of the number of codes, so that a value has few codes.
SEGMENT_BITS = 16
# Radii searched together before the first test; each later one is searched by itself.
FIRST_RADIUS = 2


def binary_code(vector: Column, bits: int) -> Column:
    """The signs of a vector as segments: array of numbers of ``SEGMENT_BITS`` bits, set where a component is positive.

    Missing and NULL components have no bit.
    """

    def segment(j: int) -> Column:
        places = range(j * SEGMENT_BITS, min(bits, (j + 1) * SEGMENT_BITS))
        parts = [F.when(F.get(vector, F.lit(i)) > 0, 1 << (i - places.start)).otherwise(0) for i in places]
        return reduce(lambda a, b: a + b, parts)

    return F.array(*(segment(j) for j in range(ceil(bits / SEGMENT_BITS))))


def hamming(a: Column, b: Column) -> Column:
    """Bits in which two codes of equal length differ."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def _masks(radii: range) -> Column:
    """All numbers of a segment with so many bits set, as a constant array."""
    found = [str(x) for x in range(1 << SEGMENT_BITS) if x.bit_count() in radii]
    return F.split(F.lit(",".join(found)), ",").cast("array<int>")


def _nearest(rows: DataFrame, keep: int) -> DataFrame:
    """The ``keep`` nearest rows of each query code, by distance, then id."""
    rank = F.row_number().over(Window.partitionBy("query").orderBy("distance", "id"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= keep).drop("rank")


def search(codes: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The ``k`` nearest of ``codes`` (id, code) to each of ``queries`` (query_id, code): query_id, rank, id, distance.

    Exact: ordered by Hamming distance, ties by id; a query never finds the row of its own id. Rows with a NULL code are
    neither found nor sought; repeated rows of one id count once. With fewer than ``k`` other rows all are returned, so
    an empty table gives none. Equal codes are searched once, and of each code only the ``k`` + 1 smallest ids can be
    among the nearest, so a code that many rows share costs no more than others.
    """
    keep = k + 1
    rows = codes.where(F.col("code").isNotNull() & F.col("id").isNotNull())
    first = F.row_number().over(Window.partitionBy("code").orderBy("id"))
    rows = stored(rows.select("id", "code").dropDuplicates(["id"]).withColumn("n", first).where(F.col("n") <= keep).drop(
        "n").groupBy("code").agg(F.collect_list("id").alias("ids")), "codes")
    wanted = stored(queries.where(F.col("code").isNotNull()).select("query_id", "code"), "queries")
    open_ = stored(wanted.select("code").distinct(), "open")
    shape = rows.select(F.size("code").alias("segments")).first()
    if shape is None:
        return wanted.select("query_id", F.lit(0).alias("rank"), F.lit(0).cast("long").alias("id"),
                             F.lit(0).alias("distance")).limit(0)
    segments = shape.segments
    index = rows.select(F.posexplode("code").alias("segment", "value"), F.col("code").alias("other"), "ids")
    best = None
    for radius in range(FIRST_RADIUS, SEGMENT_BITS + 1):
        radii = range(radius + 1) if best is None else range(radius, radius + 1)
        probes = open_.select(F.col("code").alias("query"), F.posexplode("code").alias("segment", "own")).select(
            "query", "segment", F.explode(_masks(radii)).alias("mask"), "own").select(
            "query", "segment", F.col("own").bitwiseXOR(F.col("mask")).alias("value"))
        # A pair of codes is verified once, in the first segment that brings it together.
        # Probes outnumber any estimate made before they are exploded, so they must not be broadcast.
        met = probes.join(index.hint("merge"), ["segment", "value"])
        near = F.transform(F.zip_with("query", "other", lambda x, y: F.bit_count(x.bitwiseXOR(y))), lambda d: d.cast("int"))
        found = met.withColumn("apart", near).where(
            F.array_position(F.transform("apart", lambda d: (d <= radius).cast("int")), 1) == F.col("segment") + 1)
        found = found.select("query", F.explode("ids").alias("id"),
                             F.aggregate("apart", F.lit(0), lambda s, x: s + x).alias("distance"))
        if best is not None:
            found = found.unionByName(best.join(open_, best["query"] == open_["code"], "left_semi")).dropDuplicates(
                ["query", "id"])
        now = stored(_nearest(found, keep), "nearest")
        reach = now.groupBy("query").agg(F.count(F.lit(1)).alias("n"), F.max("distance").alias("far"))
        done = reach.where((F.col("n") >= keep) & (F.col("far") <= segments * (radius + 1) - 1))
        still = stored(open_.join(done, open_["code"] == done["query"], "left_anti"), "open")
        best = now if best is None else best.join(open_, best["query"] == open_["code"], "left_anti").unionByName(now)
        open_ = still
        if open_.isEmpty():
            break
        best = stored(best, "nearest")
    ranked = wanted.join(best, wanted["code"] == best["query"]).where(F.col("id") != F.col("query_id"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "id"))
    return ranked.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "id", "distance")


def sign_codes(vectors: DataFrame) -> DataFrame:
    """``vectors`` (vec_id, embedding) as codes of their signs: (id, code), as long as the longest vector."""
    bits = vectors.agg(F.max(F.size("embedding"))).first()[0] or 0
    code = binary_code(F.col("embedding"), bits) if bits > 0 else F.lit(None).cast("array<int>")
    return vectors.select(F.col("vec_id").alias("id"), F.when(F.col("embedding").isNotNull(), code).alias("code"))


def digests(vectors: DataFrame, k: int = 10, every: int = 50) -> DataFrame:
    """The ``k`` nearest codes of every row whose id is divisible by ``every``, among all rows."""
    codes = sign_codes(vectors)
    queries = codes.where(F.col("id") % every == 0).select(F.col("id").alias("query_id"), "code")
    return search(codes, queries, k).withColumnRenamed("id", "vec_id")


def sql(k: int = 10, every: int = 50) -> str:
    """``digests`` in SQL, all queries against all rows."""
    return f"""
WITH code AS (
  SELECT vec_id, [coalesce(x > 0, false) FOR x IN embedding] AS bits FROM embeddings WHERE embedding IS NOT NULL
), pair AS (
  SELECT q.vec_id AS query_id, v.vec_id,
    len([1 FOR z IN list_zip(q.bits, v.bits) IF z[1] <> z[2]]) AS distance
  FROM code q JOIN code v ON q.vec_id % {every} = 0 AND q.vec_id <> v.vec_id
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS INTEGER) AS rank, vec_id,
  CAST(distance AS INTEGER) AS distance
FROM pair QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) <= {k}"""
