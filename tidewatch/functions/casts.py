"""Casts that give NULL instead of an error, with one fixed reading of what is a number or a timestamp."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accepted forms (fixed values): whole numbers; dates with an optional time, each with an optional zone: Z, an offset
# +H, +HH or +HH:MM, or a zone name after a space. Partial dates such as 2001-05 and counts such as 3.0 are not accepted.
WHOLE_NUMBER = r"^\s*[+-]?[0-9]+\s*$"
_DATE = r"[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}"
_CLOCK = r"([ Tt][0-9]{1,2}:[0-9]{1,2}:[0-9]{1,2}(\.[0-9]{1,6})?)?"
_ZONE = r"([Zz]| ?[+-][0-9]{1,2}(:[0-9]{1,2})?| [A-Za-z][A-Za-z0-9_+/-]*)"
LOCAL_TIMESTAMP = f"^{_DATE}{_CLOCK}$"
ZONED_TIMESTAMP = f"^{_DATE}{_CLOCK}{_ZONE}$"


def safe_long(value: Column) -> Column:
    return F.when(value.rlike(WHOLE_NUMBER), F.trim(value).try_cast("bigint"))


def safe_timestamp(value: Column) -> Column:
    """String to TIMESTAMP_NTZ in UTC; text without a zone is taken as UTC, whatever the session zone is."""

    # A date before a zone gets a clock, and what the cast wants in capitals or as a space is written so.
    timed = F.regexp_replace(value, f"^({_DATE})(?={_ZONE}$)", "$1 00:00:00")
    spelled = F.regexp_replace(F.regexp_replace(timed, r"(?<=[0-9])[Tt](?=[0-9])", " "), "(?<=[0-9])z$", "Z")
    # The usual form needs no rewriting: its one letter is the T before the clock.
    local = F.translate(value, "t", "T").try_cast("timestamp_ntz")
    return F.when(value.rlike(LOCAL_TIMESTAMP), local).when(
        value.rlike(ZONED_TIMESTAMP), _utc_clock(spelled.try_cast("timestamp")))


def _utc_clock(instant: Column) -> Column:
    """What a clock in UTC shows at an instant, as TIMESTAMP_NTZ; exact in every session zone."""
    seconds = F.unix_micros(instant).cast("decimal(22, 6)") / F.lit(1_000_000).cast("decimal(7, 0)")
    zero = F.lit(0)
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(
        zero, zero, zero, seconds.cast("decimal(18, 6)"))


def as_utc_ntz(value: Column, data_type: str) -> Column:
    """A typed time column as TIMESTAMP_NTZ in UTC."""
    if data_type == "timestamp":
        return _utc_clock(value)
    return value.cast("timestamp_ntz")


def count_at_least_one(value: Column) -> Column:
    """Missing, zero and negative counts all become 1."""
    return F.greatest(F.coalesce(value, F.lit(1)), F.lit(1)).cast("bigint")
