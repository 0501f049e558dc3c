"""Fill-in-the-middle: texts cut at two unit borders and written with the middle part last.

A unit is a word with the blanks before it, or blanks that end the text. One full match of repeated units keeps the end
of every repetition, so the number of units and both cut offsets are read from that list.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import own_name, ship, text_of

# Markers of the three parts, the seed of the choices, and rates in per cent.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED = 42
INFILL_PERCENT, SUFFIX_FIRST_PERCENT = 50, 80

# Repeats are possessive: a text of any length is matched without going back.
_UNITS = regex.compile(r"([\x20\x09-\x0D]*+[^\x20\x09-\x0D]++|[\x20\x09-\x0D]++)*+")
_PARTS = "n long, form string, prefix_chars long, middle_chars long, output string"


def choices(doc_id: Column, seed: int) -> list[Column]:
    """Four whole numbers below 2^32 from the hash of seed and id; a NULL id counts as an empty one."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def cut(text: str, h1: int, h2: int) -> tuple[int, int, int]:
    """The number of units, and the offsets where prefix and middle end."""
    ends = _UNITS.fullmatch(text).ends(1)
    n = len(ends)
    first, second = sorted((h1 % (n + 1), h2 % (n + 1)))
    return n, ends[first - 1] if first else 0, ends[second - 1] if second else 0


def infilled(text: str, h1: int, h2: int, h3: int, h4: int) -> tuple[int, str, int | None, int | None, str]:
    """Number of units, form, code points of prefix and middle (None if plain), and the text in that form."""
    n, a, b = cut(text, h1, h2)
    if not text or h3 % 100 >= INFILL_PERCENT or any(m in text for m in (PREFIX, SUFFIX, MIDDLE)):
        return n, "plain", None, None, text
    before, middle, after = text[:a], text[a:b], text[b:]
    if h4 % 100 < SUFFIX_FIRST_PERCENT:
        return n, "spm", a, b - a, f"{SUFFIX}{after}{PREFIX}{before}{MIDDLE}{middle}"
    return n, "psm", a, b - a, f"{PREFIX}{before}{SUFFIX}{after}{MIDDLE}{middle}"


def transform(docs: DataFrame, text: str = "text", key: str = "doc_id", seed: int = SEED) -> DataFrame:
    """``docs`` with ``n`` (units), ``form``, ``prefix_chars``, ``middle_chars`` and ``output``, the whole text in that form.

    Cuts and form follow from the key alone, so a task that runs again gives the same rows and repeated rows are
    transformed alike. NULL and empty texts stay plain with no unit, as do texts that hold a marker. A NULL key is
    hashed as an empty one. Long texts are matched whole, in memory that grows with one text. An empty table stays
    empty. Columns named like the new ones are replaced, all others pass untouched.
    """
    ship(docs.sparkSession)
    found = own_name(docs, "_infill")

    @F.pandas_udf(_PARTS)
    def parts(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        for texts, *h in batches:
            rows = [infilled(t, *x) for t, *x in zip(texts.tolist(), *(c.tolist() for c in h), strict=True)]
            out = pd.DataFrame(rows, columns=["n", "form", "prefix_chars", "middle_chars", "output"])
            yield out.astype({"prefix_chars": "Int64", "middle_chars": "Int64"})

    new = ["n", "form", "prefix_chars", "middle_chars", "output"]
    kept = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in new]
    done = docs.withColumn(found, parts(text_of(text), *choices(F.col(f"`{key}`"), seed)))
    return done.select(*kept, *(F.col(f"{found}.{c}").alias(c) for c in new))


def restored(output: Column, form: Column) -> Column:
    """The exact text, from the transformed one and its form alone: no marker can lie across two parts."""

    def between(start: Column, end: Column) -> Column:
        return F.substring(output, start, end - start)

    p, s, m = (F.locate(x, output) for x in (PREFIX, SUFFIX, MIDDLE))
    end, width = F.char_length(output) + 1, len(PREFIX)
    psm = F.concat(between(p + width, s), between(m + width, end), between(s + width, m))
    spm = F.concat(between(p + width, m), between(m + width, end), between(s + width, p))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def restore(df: DataFrame, output: str = "output", form: str = "form", text: str = "text") -> DataFrame:
    """``df`` with the rebuilt ``text``; rows without output give NULL, rows without form the output as it is."""
    return df.withColumn(text, restored(F.col(f"`{output}`"), F.col(f"`{form}`")))


def digests(docs: DataFrame) -> DataFrame:
    """Per document: units, form, code points of prefix and middle, SHA-256 of the output and of the text rebuilt from it."""
    return transform(docs.select("doc_id", "text")).select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"),
        F.sha2(restored(F.col("output"), F.col("form")).cast("binary"), 256).alias("restored_sha256"))


def sql() -> str:
    """The same in SQL, with units listed and their lengths summed."""
    return f"""
WITH cut AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS d,
    regexp_extract_all(coalesce(text, ''), '[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+') AS units
  FROM documents
), chosen AS (
  SELECT doc_id, t, units, len(units) AS n,
    {", ".join(f"CAST('0x' || substr(d, {8 * i + 1}, 8) AS BIGINT) AS h{i + 1}" for i in range(4))}
  FROM cut
), placed AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS u1, greatest(h1 % (n + 1), h2 % (n + 1)) AS u2,
    CASE WHEN t = '' OR contains(t, '{PREFIX}') OR contains(t, '{SUFFIX}') OR contains(t, '{MIDDLE}')
      OR h3 % 100 >= {INFILL_PERCENT} THEN 'plain' WHEN h4 % 100 < {SUFFIX_FIRST_PERCENT} THEN 'spm' ELSE 'psm' END AS form
  FROM chosen
), split AS (
  SELECT doc_id, t, n, form, array_to_string(units[1:u1], '') AS a, array_to_string(units[u1 + 1:u2], '') AS b,
    array_to_string(units[u2 + 1:], '') AS c
  FROM placed
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(a) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN length(b) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '{PREFIX}' || a || '{SUFFIX}' || c || '{MIDDLE}' || b
    ELSE '{SUFFIX}' || c || '{PREFIX}' || a || '{MIDDLE}' || b END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM split"""
