"""Text predicates and small text rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Endings that count as an image.
IMAGE_ENDINGS = ("png", "jpg", "jpeg", "gif", "bmp", "tiff", "svg")

TOKEN_BREAK = r"[^\p{L}\p{N}]+"


def blank_to_null(value: Column) -> Column:
    """'' means tried and not found; both '' and NULL count as no value."""
    return F.nullif(value, F.lit(""))


def contains_ignoring_case(value: Column, text: str, escape: bool = False) -> Column:
    """Substring match without case; ``%`` and ``_`` in the text are wildcards unless ``escape`` is set."""
    if escape:
        return F.contains(F.lower(value), F.lower(F.lit(text)))
    literal_backslashes = text.replace("\\", "\\\\")
    return value.ilike(f"%{literal_backslashes}%")


def tokens(value: Column) -> Column:
    """Lower-cased words of a text, without empty ones."""
    return F.filter(F.split(F.lower(value), TOKEN_BREAK), lambda word: word != "")


def has_all_tokens(value: Column, text: str) -> Column:
    """True where every word of the search text occurs as a whole word."""
    words = tokens(value)
    return F.forall(tokens(F.lit(text)), lambda word: F.array_contains(words, word))


def is_image_url(value: Column) -> Column:
    """Not blank, shaped like an http(s) or ftp URL, and ending like an image; never NULL."""
    url = F.lower(F.trim(value))
    host = r"(([\p{L}\p{N}_-]+\.)+[\p{L}]{2,}|[0-9]{1,3}(\.[0-9]{1,3}){3})"
    shape = r"^(https?|ftp)://" + host + r"(:[0-9]{1,5})?([/?#]\S*)?$"
    ending = r"\.(" + "|".join(IMAGE_ENDINGS) + r")$"
    return F.coalesce(url.rlike(shape) & url.rlike(ending), F.lit(False))


def display_title(common_name: Column, species: Column) -> Column:
    return F.coalesce(blank_to_null(common_name), species)
