"""Tolerant text parsing: bad input becomes null, never an error."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


WHITESPACE = " \t\n\r\x0b\x0c"


def strip(value: Column) -> Column:
    """Trim every kind of whitespace, not only blanks."""
    return F.btrim(value.cast("string"), F.lit(WHITESPACE))


def text(value: Column) -> Column:
    """Trimmed text with missing as the empty string."""
    return strip(F.coalesce(value.cast("string"), F.lit("")))


def blank_to_null(value: Column) -> Column:
    return F.nullif(strip(value), F.lit(""))


def first_text(*values: Column) -> Column:
    """First non-blank of several alias columns, else the empty string."""
    return F.coalesce(*[blank_to_null(v) for v in values], F.lit(""))


def float_or_null(value: Column) -> Column:
    """Finite double or null."""
    parsed = strip(value).try_cast("double")
    return F.when(~F.isnan(parsed) & (F.abs(parsed) != F.lit(float("inf"))), parsed)


def strict_int_text(value: Column) -> Column:
    """Integer text with an optional sign; ``100.0`` is rejected."""
    raw = F.regexp_replace(strip(value), r"^\+", "")
    return F.when(raw.rlike(r"^-?\d+$"), raw.try_cast("long"))


def near_int_text(value: Column) -> Column:
    """Integer text, also accepting decimals within 1e-6 of an integer."""
    raw = F.regexp_replace(strip(value), r"^\+", "")
    parsed = raw.try_cast("double")
    rounded = F.bround(parsed, 0)
    return F.coalesce(
        strict_int_text(value),
        F.when(F.abs(parsed - rounded) <= 1e-6, rounded.try_cast("long")),
    )


def american_price(value: Column, is_text: bool = False) -> Column:
    """Whole-number price: numbers are truncated, text must be an integer."""
    if is_text:
        return strict_int_text(value).try_cast("int")
    return value.try_cast("int")


def side(value: Column) -> Column:
    """``over``/``under`` from their long or one-letter spelling, else null."""
    raw = F.lower(F.trim(value))
    return F.when(raw.isin("over", "o"), F.lit("over")).when(raw.isin("under", "u"), F.lit("under"))


def result_label(value: Column, with_push: bool = True) -> Column:
    raw = F.lower(F.trim(F.coalesce(value, F.lit(""))))
    out = F.when(raw.isin("w", "win"), F.lit("win")).when(raw.isin("l", "loss"), F.lit("loss"))
    if with_push:
        out = out.when(raw.isin("p", "push"), F.lit("push"))
    return out.otherwise(F.lit(""))


def clock_minutes(value: Column) -> Column:
    """Minutes from ``PT34M12.00S``, ``mm:ss`` or a plain number."""
    raw = strip(value)
    iso = r"^PT(?:(\d+)M)?(?:(\d+(?:\.\d+)?)S)?$"
    colon = r"^(\d+):(\d+(?:\.\d*)?)$"

    def group(pattern: str, index: int) -> Column:
        return F.coalesce(
            F.regexp_extract(raw, pattern, index).try_cast("double"), F.lit(0.0)
        )

    return (
        F.when(raw.rlike(iso), group(iso, 1) + group(iso, 2) / 60.0)
        .when(raw.rlike(colon), group(colon, 1) + group(colon, 2) / 60.0)
        .when(raw.rlike(r"^-?\d+(\.\d*)?$"), raw.try_cast("double"))
    )


def csv_text(value: Column) -> Column:
    """Array parameter as comma-separated text without blanks."""
    cleaned = F.transform(value, lambda item: F.trim(item))
    return F.concat_ws(",", F.filter(cleaned, lambda item: item != ""))


def season_slug(value: Column) -> Column:
    return F.regexp_replace(
        F.regexp_replace(F.lower(value), r"[^a-z0-9]+", "_"), r"^_+|_+$", ""
    )


def redact_key(value: Column) -> Column:
    """Hide API keys in error text."""
    return F.regexp_replace(value, r"([?&](?:apiKey|api_key)=)[^&\s'\"]+", "$1REDACTED")
