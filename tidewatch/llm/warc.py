"""Web archives in which equal payloads are stored once.

Headers (ids, addresses, payload digests) are shuffled by digest without the payloads. The first record of a digest
stays a response, the others become revisits that name it; revisits read from older archives are joined to their
originals the same way. Every record is written under a fresh header, as WARC 1.1 in gzip files.

Archives are written and read by Spark's text source: a record ends with two line ends, which are its row separator.
Compressed files are not split, so one task streams an archive in order and holds one record at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm.common import own_name, ship, stored
from tidewatch.operators.joins import lookup_join
from tidewatch.session import new_table_path

# Payloads of fewer bytes are stored each time: a revisit record would not be smaller.
LEAST_BYTES = 100
# An archive holds at most so many records.
ARCHIVE_RECORDS = 10_000
# Records leave a reading task together up to these.
BATCH_RECORDS, BATCH_BYTES = 2_000, 4_000_000

# Fixed values of the archive format.
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_LINE = "\r\n"
_END = _LINE + _LINE
# What parts two records for Spark's reader. A payload that holds it is written in chunks cut inside it.
_BORDER = _END + "WARC/"

_SQL_TYPES = {pa.string(): "string", pa.int64(): "long", pa.binary(): "binary"}
_READ = pa.schema([
    ("archive", pa.string()), ("record_type", pa.string()), ("record_id", pa.string()), ("page_id", pa.int64()),
    ("url", pa.string()), ("date", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()),
    ("payload_digest", pa.string()), ("stated_digest", pa.string()), ("refers_to_id", pa.string()),
])
_READ_SQL = ", ".join(f"{f.name} {_SQL_TYPES[f.type]}" for f in _READ)
_PAYLOAD = _READ.get_field_index("payload")


def described(pages: DataFrame, payload: str = "html") -> DataFrame:
    """``pages`` as records: ``page_id``, ``url``, ``payload`` (UTF-8, NULL as empty), its bytes and SHA-256."""
    body = F.coalesce(F.col(f"`{payload}`"), F.lit("")).cast("binary")
    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", body.alias("payload")).select(
        "*", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_digest"))


def _first() -> Column:
    """The record that stays: smallest page_id (none comes last), then smallest address, responses before revisits."""
    return F.min(F.struct(
        F.when(F.col("record_type") == "revisit", 1).otherwise(0).alias("kind"), F.col("page_id").isNull().alias("no_id"),
        "page_id", F.col("url").isNull().alias("no_url"), "url"))


def originals(headers: DataFrame) -> DataFrame:
    """Per payload digest that several records have, the response the others refer to: ``to_id``, ``to_url``.

    ``headers`` has record_type (NULL where not decided), page_id, url, payload_bytes, payload_digest. Equal digests are
    counted before they are shuffled, so a payload of a third of all rows is one row a task.
    """
    return headers.groupBy("payload_digest").agg(
        _first().alias("first"), F.count(F.lit(1)).alias("copies"), F.max("payload_bytes").alias("bytes"),
        F.max(F.coalesce(F.col("record_type") == "revisit", F.lit(False))).alias("revisited"),
    ).where(f"copies > 1 AND first.kind = 0 AND (bytes >= {LEAST_BYTES} OR revisited)").select(
        "payload_digest", F.col("first.page_id").alias("to_id"), F.col("first.url").alias("to_url"))


def deduplicated(records: DataFrame) -> DataFrame:
    """``records`` with ``record_type``, ``refers_to`` (page_id of the response) and ``refers_to_url``.

    Of records with equal payloads of at least ``LEAST_BYTES`` bytes the one with the smallest page_id is the response
    and the others revisit it; smaller ones are all responses. A NULL page_id comes last; of equal ids the smallest
    address decides, and rows equal in both to the response are responses too. A record that came as a revisit stays
    one, and refers to nothing where no record has its payload. Columns of the new names are replaced, all others pass
    untouched; an empty table stays empty.
    """
    if "record_type" not in records.columns:
        records = records.withColumn("record_type", F.lit(None).cast("string"))
    base = records.drop("refers_to", "refers_to_url")
    firsts = stored(originals(base.select("record_type", "page_id", "url", "payload_bytes", "payload_digest")), "warc_originals")
    to_id, to_url, found = (own_name(base, x) for x in ("_to_id", "_to_url", "_found"))
    joined = lookup_join(base, firsts.select(
        "payload_digest", F.col("to_id").alias(to_id), F.col("to_url").alias(to_url), F.lit(True).alias(found)),
        "payload_digest", "left", size_of=firsts)
    was = F.coalesce(F.col("record_type") == "revisit", F.lit(False))
    same = F.col("page_id").eqNullSafe(F.col(to_id)) & F.col("url").eqNullSafe(F.col(to_url))
    copy = F.col(found).isNotNull() & ~same & (F.col("payload_bytes") >= LEAST_BYTES)
    revisit = was | F.coalesce(copy, F.lit(False))
    kept = [F.col(f"`{c}`") for c in base.columns if c != "record_type"]
    return joined.select(
        *kept, F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")).alias("record_type"),
        F.when(revisit, F.col(to_id)).alias("refers_to"), F.when(revisit, F.col(to_url)).alias("refers_to_url"))


def record_id(page_id: Column, url: Column, digest: Column) -> Column:
    """An id made from page, address and payload, so that a task that runs again names its records alike."""
    h = F.sha2(F.concat_ws("\n", page_id.cast("string"), F.coalesce(url, F.lit("")), digest), 256)
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *(
        F.substring(h, at, n) for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))), F.lit(">"))


def _address(url: Column) -> Column:
    """An address fit for a header line: blanks and line ends as percent escapes."""
    for blank, code in ((" ", "%20"), ("\t", "%09"), ("\r", "%0D"), ("\n", "%0A")):
        url = F.replace(url, F.lit(blank), F.lit(code))
    return url


def _chunked(body: Column) -> Column:
    """The body in chunks (HTTP transfer coding), each border inside an occurrence of the record separator."""
    # One letter a byte, so that bytes which are no text survive the pattern.
    inner = F.split(F.decode(body.cast("binary"), "ISO-8859-1"), f"(?<={_END})(?=WARC/)")
    pieces = F.transform(inner, lambda x: F.concat(F.lower(F.hex(F.length(x))), F.lit(_LINE), x, F.lit(_LINE)))
    return F.encode(F.concat(F.array_join(pieces, ""), F.lit(f"0{_END}")), "ISO-8859-1").cast("string")


def _lines(*fields: tuple[str, Column]) -> Column:
    """Header lines; a field whose value is NULL has none."""
    return F.concat(*(F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(_LINE)), F.lit("")) for name, value in fields))


def write(records: DataFrame, path: str, date: datetime | None = None, archive_records: int = ARCHIVE_RECORDS) -> None:
    """Write deduplicated records as archives under ``path``, each with a fresh header.

    ``records`` is what ``deduplicated`` returns. A response holds its whole payload behind an HTTP header, a revisit
    only names its response. ``page_id`` is kept in an own header field; a NULL address has no address line.
    Payloads need not be text. The files are committed as any table, so a lost task leaves none half written.
    """
    at = F.lit((date or datetime.now(UTC)).strftime("%Y-%m-%dT%H:%M:%SZ"))
    body = F.coalesce(F.col("payload"), F.lit(b"")).cast("string")
    split = F.locate(_BORDER, body) > 0
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{_LINE}"), _lines(
        ("Content-Type", F.lit("text/html; charset=utf-8")),
        ("Transfer-Encoding", F.when(split, F.lit("chunked"))),
        ("Content-Length", F.when(~split, F.octet_length(body).cast("string")))), F.lit(_LINE))
    response = F.col("record_type") == "response"
    block = F.when(response, F.concat(http, F.when(split, _chunked(body)).otherwise(body))).otherwise(
        F.lit(f"HTTP/1.1 200 OK{_END}"))
    with_block = own_name(records, "_block")
    row = records.withColumn(with_block, block)
    named = F.col("refers_to").isNotNull() | F.col("refers_to_url").isNotNull()
    # A revisit whose response is not among the records still names the one it named before.
    before = F.col("refers_to_id") if "refers_to_id" in records.columns else F.lit(None).cast("string")
    header = F.concat(F.lit(f"{VERSION}{_LINE}"), _lines(
        ("WARC-Type", F.col("record_type")),
        ("WARC-Record-ID", record_id(F.col("page_id"), F.col("url"), F.col("payload_digest"))),
        ("WARC-Date", at),
        ("WARC-Target-URI", F.when(F.col("url") != "", _address(F.col("url")))),
        ("WARC-Page-ID", F.col("page_id").cast("string")),
        ("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("payload_digest"))),
        ("WARC-Profile", F.when(~response, F.lit(PROFILE))),
        ("WARC-Refers-To", F.when(~response, F.when(named, record_id(
            F.col("refers_to"), F.col("refers_to_url"), F.col("payload_digest"))).otherwise(before))),
        ("WARC-Refers-To-Target-URI", F.when(~response & named, _address(F.col("refers_to_url")))),
        ("Content-Type", F.lit("application/http; msgtype=response")),
        ("Content-Length", F.octet_length(with_block).cast("string"))), F.lit(_LINE))
    out = row.select(F.concat(header, F.col(with_block)).alias("value"))
    (out.write.option("lineSep", _END).option("compression", "gzip").option("maxRecordsPerFile", archive_records).text(path))


def _fields(lines: list[bytes]) -> dict[bytes, str]:
    """Header lines by lower-case name; a line that starts with a blank continues the one before."""
    found: dict[bytes, str] = {}
    name = b""
    for line in lines:
        if line[:1] in b" \t" and name:
            found[name] += " " + line.decode("utf-8", "replace").strip()
            continue
        name, _, value = line.partition(b":")
        name = name.strip().lower()
        found[name] = value.decode("utf-8", "replace").strip()
    return found


def _dechunked(body: bytes) -> bytes:
    parts, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        size = int(body[at:end].split(b";")[0], 16)
        if not size:
            return b"".join(parts)
        parts.append(body[end + 2:end + 2 + size])
        at = end + 4 + size


def _parsed(raw: bytes, archive: str) -> tuple:
    """One record, from its version line to the end of its block."""
    head, _, block = raw.partition(b"\r\n\r\n")
    fields = _fields(head.split(b"\r\n")[1:])
    kind, payload = fields.get(b"warc-type", ""), block
    if b"http" in fields.get(b"content-type", "").encode():
        http, _, payload = block.partition(b"\r\n\r\n")
        if "chunked" in _fields(http.split(b"\r\n")[1:]).get(b"transfer-encoding", ""):
            payload = _dechunked(payload)
    stated = fields.get(b"warc-payload-digest", "").rpartition(":")[2] or None
    has = kind != "revisit"
    page = fields.get(b"warc-page-id")
    return (archive, kind, fields.get(b"warc-record-id"), int(page) if page else None, fields.get(b"warc-target-uri"),
            fields.get(b"warc-date"), payload if has else None, len(payload) if has else None,
            hashlib.sha256(payload).hexdigest() if has else stated, stated, fields.get(b"warc-refers-to"))


def _missing(raw: bytes) -> int:
    """How many bytes of the record's block are not there yet."""
    at = raw.find(b"\r\n\r\n")
    if at < 0:
        return 1
    return int(_fields(raw[:at].split(b"\r\n")[1:]).get(b"content-length", "0")) - (len(raw) - at - 4)


def records_of(pieces: Iterator[tuple[str, bytes]]) -> Iterator[tuple[str, bytes]]:
    """Whole records from what lies between separators, in the order of each file.

    A block may hold the separator itself (archives of others): pieces are joined until the stated length is there.
    """
    archive, raw = None, b""

    def checked(record: bytes) -> tuple[str, bytes]:
        # Line ends after the last record of a file are no part of it.
        missing = _missing(record)
        block = record if missing >= 0 else record[:missing]
        if missing > 0 or record[len(block):].strip(b"\r\n"):
            raise ValueError(f"{archive}: a record is not as long as its header says")
        return archive, block

    for name, piece in pieces:
        if name != archive:
            if raw:
                yield checked(raw)
            archive, raw = name, piece
            continue
        if _missing(raw) > 0:
            raw += _BORDER.encode() + piece
            continue
        yield checked(raw)
        raw = b"WARC/" + piece
    if raw:
        yield checked(raw)


def read(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """The records of the gzip archives under ``path``, with payload bytes and digest computed from what is stored.

    Revisits have no payload and no length, and the digest they state. ``payloads=False`` leaves the payloads out. One
    task reads an archive. A record whose length differs from its header fails the job. Records without own page field
    have a NULL ``page_id``; an empty folder gives no rows.
    """
    ship(spark)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pieces():
            for batch in batches:
                for name, value in zip(*(batch.column(i) for i in (0, 1)), strict=True):
                    yield name.as_py(), value.as_py()

        def packed(rows: list[list]) -> pa.RecordBatch:
            columns = zip(zip(*rows, strict=True), _READ.types, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in columns], schema=_READ)

        rows, held = [], 0
        for archive, raw in records_of(pieces()):
            row = list(_parsed(raw, archive))
            if not payloads:
                row[_PAYLOAD] = None
            rows.append(row)
            held += len(row[_PAYLOAD] or b"")
            if len(rows) >= BATCH_RECORDS or held >= BATCH_BYTES:
                yield packed(rows)
                rows, held = [], 0
        if rows:
            yield packed(rows)

    found = spark.read.option("lineSep", _BORDER).text(path).select(
        F.col("_metadata.file_path").alias("archive"), F.col("value").cast("binary").alias("value"))
    out = found.mapInArrow(parse, _READ_SQL)
    return out if payloads else out.drop("payload")


def resolved(records: DataFrame) -> DataFrame:
    """``records`` as read, each revisit with the length of its response's payload and ``refers_to``, its page_id.

    A revisit is joined to the response with the id it names; one that names none, or one not among the records, to the
    first response with its payload digest. What has no original keeps NULL. ``payload`` is not copied into revisits.
    """
    headers = records.drop("payload")
    said = headers.where("record_type <> 'revisit'").select(
        "record_id", "page_id", "url", "payload_bytes", "payload_digest", "record_type")
    revisits = headers.where("record_type = 'revisit'")
    digests = stored(revisits.groupBy("payload_digest").agg(F.count(F.lit(1)).alias("n")).drop("n"), "warc_digests")
    candidates = stored(lookup_join(said, digests, "payload_digest", "left_semi"), "warc_responses")
    first = candidates.groupBy("payload_digest").agg(_first().alias("first"), F.first("payload_bytes").alias("first_bytes")).select(
        "payload_digest", F.col("first.page_id").alias("first_id"), "first_bytes")
    named = candidates.groupBy(F.col("record_id").alias("refers_to_id")).agg(
        F.min("page_id").alias("named_id"), F.min("payload_bytes").alias("named_bytes"))
    joined = lookup_join(lookup_join(revisits, named, "refers_to_id", "left", size_of=candidates),
                         first, "payload_digest", "left", size_of=candidates)
    length, to = F.coalesce("named_bytes", "first_bytes"), F.when(
        F.col("named_bytes").isNotNull(), F.col("named_id")).otherwise(F.col("first_id"))
    plain = [c for c in headers.columns if c not in ("payload_bytes",)]
    return headers.where("record_type <> 'revisit'").select(
        *plain, "payload_bytes", F.lit(None).cast("long").alias("refers_to")).unionByName(
        joined.select(*plain, length.alias("payload_bytes"), to.alias("refers_to")))


def rewritten(spark: SparkSession, old: str, new: str, date: datetime | None = None) -> None:
    """Responses and revisits of the archives under ``old``, written anew without repeated payloads.

    Revisits are joined to their originals. Records of other types describe the old archives and are not carried over.
    """
    records = read(spark, old).where("record_type IN ('response', 'revisit')")
    lengths = stored(resolved(records).where("record_type = 'revisit'").groupBy("payload_digest").agg(
        F.max("payload_bytes").alias("length")), "warc_lengths")
    filled = lookup_join(records, lengths, "payload_digest", "left").withColumn(
        "payload_bytes", F.coalesce("payload_bytes", "length")).drop("length")
    write(deduplicated(filled), new, date)


def digests(pages: DataFrame) -> DataFrame:
    """Per page, from archives written and read again: payload bytes and digest, type, and the response revisited."""
    spark = pages.sparkSession
    path = new_table_path(spark, "warc")
    write(deduplicated(described(pages.select("page_id", "url", "html"))), path)
    # Headers are read once and kept: resolving looks at them several times.
    return resolved(stored(read(spark, path, payloads=False), "warc_headers")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def sql() -> str:
    """The same in SQL, without archives."""
    return f"""
WITH page AS (
  SELECT page_id, coalesce(html, '') AS payload FROM pages
), first AS (
  SELECT *, min(page_id) OVER (PARTITION BY payload) AS original FROM page
)
SELECT page_id, strlen(payload) AS payload_bytes, sha256(payload) AS payload_digest,
  CASE WHEN strlen(payload) >= {LEAST_BYTES} AND page_id <> original THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN strlen(payload) >= {LEAST_BYTES} AND page_id <> original THEN original END AS refers_to
FROM first"""
