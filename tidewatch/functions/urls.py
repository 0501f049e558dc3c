"""Address of a media thumbnail, from the address of its file page."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the address layout the media host uses for scaled images.
THUMB_ROOT = "https://upload.wikimedia.org/wikipedia/commons/thumb/"


def percent_decode(value: Column) -> Column:
    """Percent-decoding only: a plus sign stays a plus sign."""
    return F.try_url_decode(F.replace(value, F.lit("+"), F.lit("%2B")))


def percent_encode(value: Column) -> Column:
    """Percent-encoding that keeps letters, digits and ``_.-~/``."""
    form = F.url_encode(value)
    for coded, plain in (("+", "%20"), ("*", "%2A"), ("%7E", "~"), ("%2F", "/")):
        form = F.replace(form, F.lit(coded), F.lit(plain))
    return form


def thumbnail_url(page_url: Column, width: int = 800) -> Column:
    """The file name is the last path part; its MD5 names the two folders the scaled image lies in."""
    name = F.replace(percent_decode(F.substring_index(page_url, "/", -1)), F.lit(" "), F.lit("_"))
    digest = F.md5(name)
    coded = percent_encode(name)
    return F.concat(
        F.lit(THUMB_ROOT), F.substring(digest, 1, 1), F.lit("/"), F.substring(digest, 1, 2), F.lit("/"),
        coded, F.lit(f"/{width}px-"), coded,
    )
