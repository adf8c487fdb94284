"""Time handling: UTC instants, Eastern labels and local-day windows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from oddsloom.functions.parsing import strip

EASTERN = "America/New_York"
ISO_Z = "yyyy-MM-dd'T'HH:mm:ss'Z'"


def parse_instant(value: Column) -> Column:
    """ISO-8601 text to a UTC timestamp; text without a zone is taken as UTC."""
    return F.try_to_timestamp(strip(value))


def iso_text(value: Column) -> Column:
    return F.coalesce(F.date_format(value, ISO_Z), F.lit(""))


def try_day(value: Column) -> Column:
    """Date from strict ``yyyy-MM-dd`` text."""
    return F.when(value.rlike(r"^\d{4}-\d{2}-\d{2}$"), value.try_cast("date"))


def tip_label(value: Column) -> Column:
    """Tip-off time of day in Eastern time."""
    local = F.from_utc_timestamp(value, EASTERN)
    return F.coalesce(F.concat(F.date_format(local, "hh:mm a"), F.lit(" ET")), F.lit(""))


def eastern_date_label(value: Column) -> Column:
    local = F.from_utc_timestamp(value, EASTERN)
    return F.concat(F.date_format(local, "EEEE, MMM dd, yyyy"), F.lit(" (ET)"))


def eastern_stamp(value: Column) -> Column:
    """Eastern wall-clock text with the zone abbreviation in force."""
    local = F.from_utc_timestamp(value, EASTERN)
    hours = (F.unix_timestamp(local) - F.unix_timestamp(value)) / 3600
    zone = F.when(hours == -4, F.lit(" EDT")).otherwise(F.lit(" EST"))
    return F.coalesce(F.concat(F.date_format(local, "yyyy-MM-dd hh:mm:ss a"), zone), F.lit(""))


def snapshot_day(snapshot_id: Column) -> Column:
    """Modeled day named by a snapshot id: ISO prefix, ``daily-`` prefix or ISO suffix."""
    raw = strip(snapshot_id)
    daily = F.regexp_replace(
        F.regexp_extract(raw, r"^daily-(\d{4}-?\d{2}-?\d{2})", 1), "-", ""
    )
    dashed = F.concat_ws(
        "-", F.substring(daily, 1, 4), F.substring(daily, 5, 2), F.substring(daily, 7, 2)
    )
    suffix = F.regexp_extract(raw, r"(\d{4}-\d{2}-\d{2})$", 1)
    return F.coalesce(try_day(F.substring(raw, 1, 10)), try_day(dashed), try_day(suffix))


def modeled_day(label: Column) -> Column:
    """Date of a modeled-date label such as ``Monday, Jan 05, 2026 (ET)`` or ISO text."""
    raw = strip(label)
    long_form = F.regexp_extract(
        raw, r"^[A-Za-z]+, ([A-Za-z]{3} \d{1,2}, \d{4}) \(ET\)$", 1
    )
    parsed = F.try_to_timestamp(F.nullif(long_form, F.lit("")), F.lit("MMM d, yyyy"))
    return F.coalesce(parsed.cast("date"), try_day(raw))


def row_day(label: Column, snapshot_id: Column) -> Column:
    return F.coalesce(modeled_day(label), snapshot_day(snapshot_id))


def day_start_utc(day: Column, zone: str = EASTERN) -> Column:
    """UTC instant at which the local day begins."""
    return F.to_utc_timestamp(day.cast("timestamp"), zone)


def day_end_utc(day: Column, zone: str = EASTERN) -> Column:
    return F.to_utc_timestamp(F.date_add(day, 1).cast("timestamp"), zone)


def anchor_utc(day: Column, hour: int, zone: str = EASTERN) -> Column:
    """UTC instant of a local anchor hour (limited to 0..23)."""
    seconds = max(0, min(int(hour), 23)) * 3600
    local = F.timestamp_seconds(F.unix_timestamp(day.cast("timestamp")) + seconds)
    return F.to_utc_timestamp(local, zone)


def minutes_before(value: Column, minutes: int) -> Column:
    return F.timestamp_seconds(F.unix_timestamp(value) - 60 * max(0, int(minutes)))


def minutes_between(later: Column, earlier: Column) -> Column:
    return (F.unix_micros(later) - F.unix_micros(earlier)) / F.lit(60_000_000.0)


def report_stamp(text_col: Column) -> Column:
    """UTC instant of an ``Injury Report: mm/dd/yy hh:mm AM`` line (Eastern time)."""
    pattern = r"(?i)Injury Report:\s*(\d{2})/(\d{2})/(\d{2,4})\s+(\d{1,2}):(\d{2})\s*(AM|PM)"

    def part(index: int) -> Column:
        return F.regexp_extract(text_col, pattern, index)

    year = part(3).try_cast("int")
    year = F.when(year < 100, year + 2000).otherwise(year)
    hour = part(4).try_cast("int") % 12 + F.when(F.upper(part(6)) == "PM", 12).otherwise(0)
    local = F.concat(
        F.lpad(year.cast("string"), 4, "0"), F.lit("-"), part(1), F.lit("-"), part(2), F.lit(" "),
        F.lpad(hour.cast("string"), 2, "0"), F.lit(":"), part(5), F.lit(":00"),
    )
    return F.to_utc_timestamp(local.try_cast("timestamp"), EASTERN)
