"""Timestamp extraction and formatting expressions (all native Spark)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference's behaviour.
# ---------------------------------------------------------------------------

# Variant A: searched anywhere in the line, first that parses wins.
TS_A_PATTERNS = [
    r"(\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}\.\d+Z?)",
    r"(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}\.\d+)",
    r"(\d{2}/\w{3}/\d{4}:\d{2}:\d{2}:\d{2})",
]

# Variant B: a head line starts (after leading blanks) with one of these.
HEAD_B_RE = r"^\s*\[?\d{4}-\d{2}-\d{2}[T\s]\d{2}:\d{2}:\d{2}"
# Extraction is anchored on the raw line (no strip); the fraction is dropped.
TS_B_RE = r"^\[?(\d{4}-\d{2}-\d{2})[T\s](\d{2}:\d{2}:\d{2})"

# ---------------------------------------------------------------------------

_FRACTION_FMT = "yyyy-MM-dd HH:mm:ss.SSSSSS"


def _iso_fraction(line: Column, pattern: str) -> Column:
    date = F.regexp_extract(line, pattern, 1)
    clock = F.regexp_extract(line, pattern, 2)
    frac = F.rpad(F.substring(F.regexp_extract(line, pattern, 3), 1, 6), 6, "0")
    text = F.concat(date, F.lit(" "), clock, F.lit("."), frac)
    return F.when(date != "", F.try_to_timestamp(text, F.lit(_FRACTION_FMT)))


def ts_a(line: Column) -> Column:
    """Variant A timestamp: ISO with fraction, space-separated with fraction, or
    Common Log Format; fraction truncated to microseconds."""
    iso_t = _iso_fraction(line, r"(\d{4}-\d{2}-\d{2})T(\d{2}:\d{2}:\d{2})\.(\d+)")
    iso_sp = _iso_fraction(line, r"(\d{4}-\d{2}-\d{2}) (\d{2}:\d{2}:\d{2})\.(\d+)")
    clf_text = F.regexp_extract(line, TS_A_PATTERNS[2], 1)
    clf = F.when(clf_text != "", F.try_to_timestamp(clf_text, F.lit("dd/MMM/yyyy:HH:mm:ss")))
    return F.coalesce(iso_t, iso_sp, clf)


def is_head_b(line: Column) -> Column:
    return line.rlike(HEAD_B_RE)


def ts_b(line: Column) -> Column:
    """Variant B head timestamp at second precision; NULL when it does not parse
    (the reference substitutes the wall clock, which is not reproducible)."""
    date = F.regexp_extract(line, TS_B_RE, 1)
    clock = F.regexp_extract(line, TS_B_RE, 2)
    return F.when(date != "", F.try_to_timestamp(F.concat(date, F.lit(" "), clock),
                                                 F.lit("yyyy-MM-dd HH:mm:ss")))


def iso_seconds(ts: Column) -> Column:
    """``2024-01-01T00:00:07Z`` (the variant B output form)."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def iso_micros(ts: Column) -> Column:
    """``2024-01-01T00:00:07.179575Z`` (variant A output, fixed 6 digits)."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def epoch_us(ts: Column) -> Column:
    return F.unix_micros(ts)


def interval_seconds(interval: str) -> int:
    """Seconds of a text like ``5 minutes``."""
    n, unit = interval.split()
    return int(n) * {"second": 1, "minute": 60, "hour": 3600, "day": 86400}[unit.rstrip("s")]
