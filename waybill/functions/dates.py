"""Dates as source text, wall clocks in zones, and instants in epoch milliseconds.

All arithmetic is on TIMESTAMP_NTZ, so results do not depend on the session time zone.
"""

from __future__ import annotations

import zoneinfo

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from waybill import vocab
from waybill.functions.text import wide_trim

DATE_SHAPE = (
    r"^(\d{4}-\d{2}-\d{2})"
    r"(?:[T ](\d{2}):(\d{2})(?::(\d{2})(?:\.(\d{1,9}))?)?(Z|[+-]\d{2}(?::?\d{2})?)?)?$"
)
UTC_NAMES = ("UTC", "Etc/UTC", "GMT", "Z", "+00:00")
# Not zones a calendar knows: files of the zone database itself.
NOT_ZONES = {"localtime", "Factory", "posixrules", "leapseconds", "tzdata.zi"}


# Zone names the JVM knows only under another name.
JVM_ZONES = {"ROC": "Asia/Taipei"}


def zone_names() -> list[str]:
    return sorted(zoneinfo.available_timezones() - NOT_ZONES)


def jvm_zone(zone: Column | str) -> Column:
    """A zone under the name the JVM knows it by."""
    if isinstance(zone, str):
        return F.lit(JVM_ZONES.get(zone, zone))
    return vocab.lookup(zone, JVM_ZONES, zone)


def is_valid_zone(zone: Column) -> Column:
    return F.coalesce(zone.isin(zone_names()), F.lit(False))


def epoch_ms(wall: Column) -> Column:
    """Milliseconds from the epoch to a TIMESTAMP_NTZ read as UTC, whatever the session zone.

    Under a UTC session the cast to an instant is exact and cheapest; under any other it would
    apply the session's own offset, so the parts of the wall clock are added up instead.
    """
    session = SparkSession.getActiveSession()
    if session is not None and session.conf.get("spark.sql.session.timeZone") in UTC_NAMES:
        return F.unix_millis(wall.cast("timestamp"))
    days = F.unix_date(wall.cast("date")).cast("bigint")
    minutes = days * 1440 + F.hour(wall) * 60 + F.minute(wall)
    millis = F.floor(F.date_part(F.lit("SECOND"), wall) * 1000).cast("bigint")
    return minutes * 60_000 + millis


def instant(wall: Column) -> Column:
    """A TIMESTAMP_NTZ read as UTC, as a TIMESTAMP to the microsecond."""
    micros = F.floor(F.date_part(F.lit("SECOND"), wall) * 1_000_000).cast("bigint") % 1000
    return F.timestamp_micros(epoch_ms(wall) * 1000 + micros)


def zoned_to_epoch(wall: Column, zone: Column | str) -> Column:
    """Wall clock in a zone to an instant: a gap moves forward, an overlap takes the earlier one."""
    return epoch_ms(F.convert_timezone(jvm_zone(zone), F.lit("UTC"), wall))


def date_only_epoch(day: Column, zone: Column | str, hour: int = 4) -> Column:
    """A day without a time: 04:00 on the wall clock of the zone."""
    wall = day.cast("date").cast("timestamp_ntz") + F.expr(f"INTERVAL '{hour}' HOUR")
    return zoned_to_epoch(wall, zone)


def _wall(ms: Column, zone: Column | str) -> Column:
    start = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    utc = F.timestamp_add("MILLISECOND", ms, start)
    return F.convert_timezone(F.lit("UTC"), jvm_zone(zone), utc)


def epoch_to_zoned_date(ms: Column, zone: Column | str) -> Column:
    """Calendar day of an instant in a zone."""
    return _wall(ms, zone).cast("date").cast("string")


def zone_offset_ms(ms: Column, zone: Column | str) -> Column:
    """Offset (zone less UTC) in effect at an instant."""
    return epoch_ms(_wall(ms, zone)) - ms


def epoch_to_iso(value: Column) -> Column:
    """Milliseconds, as a number or as up to 16 digits of text, to ISO text; null otherwise."""
    text = value.cast("string")
    ms = F.when(text.rlike(r"^-?\d{1,16}$"), text.try_cast("bigint"))
    return F.date_format(_wall(ms, "UTC"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def with_parsed_date(
    df: DataFrame, value: Column, zone: Column, default_zone: str, out: str
) -> DataFrame:
    """Add ISO date or date-time text as a struct ``out``; null when it is not one.

    kind (date | datetime), day, epoch_ms (date-times), had_offset, assumed_zone. A named but
    unknown zone falls back to the default and does not count as assumed. Written as stacked
    projections, so the text is matched once and all stays inside code generation.
    """
    text = wide_trim(value)
    split = df.withColumn(
        "_p", F.when(text.rlike(DATE_SHAPE), F.split(F.regexp_replace(text, DATE_SHAPE, "$1|$2|$3|$4|$5|$6"), r"\|"))
    ).withColumn("_z", zone)
    part = lambda i: F.get("_p", F.lit(i))
    fields = split.withColumns(
        {
            "_day": F.when(F.substring(part(0), 1, 4) >= "0100", part(0)).try_cast("date"),
            "_hour": part(1),
            "_clock": F.concat_ws(":", part(1), part(2), F.when(part(3) == "", F.lit("00")).otherwise(part(3))),
            "_millis": F.rpad(F.substring(part(4), 1, 3), 3, "0"),
            "_offset": part(5),
        }
    )
    digits = F.rpad(F.replace(F.substring("_offset", 2, 5), F.lit(":"), F.lit("")), 4, "0")
    minutes = F.substring(digits, 1, 2).try_cast("int") * 60 + F.substring(digits, 3, 2).try_cast("int")
    offset, timed = F.col("_offset"), F.col("_hour") != ""
    walls = fields.withColumns(
        {
            "_wall": F.when(
                timed & F.col("_clock").rlike("^([01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9]$"),
                F.concat(F.col("_day").cast("string"), F.lit(" "), "_clock", F.lit("."), "_millis"),
            ).try_cast("timestamp_ntz"),
            "_minutes": F.when(offset == "Z", F.lit(0)).when(offset.startswith("-"), -minutes).otherwise(minutes),
            "_used": F.when(is_valid_zone(F.col("_z")), F.col("_z")).otherwise(F.lit(default_zone)),
        }
    )
    wall = F.col("_wall")
    epoch = F.when(offset != "", epoch_ms(wall) - F.col("_minutes").cast("bigint") * 60_000).otherwise(
        zoned_to_epoch(wall, F.col("_used"))
    )
    no_zone = F.col("_z").isNull() | (F.col("_z") == "")
    parsed = F.when(
        F.col("_day").isNotNull() & (~timed | wall.isNotNull()),
        F.struct(
            F.when(timed, F.lit("datetime")).otherwise(F.lit("date")).alias("kind"),
            F.col("_day").alias("day"),
            F.when(timed, epoch).alias("epoch_ms"),
            (timed & (offset != "")).alias("had_offset"),
            (timed & (offset == "") & no_zone).alias("assumed_zone"),
        ),
    )
    return walls.withColumn(out, parsed).drop(
        "_p", "_z", "_day", "_hour", "_clock", "_millis", "_offset", "_wall", "_minutes", "_used"
    )


def with_converted_date(
    df: DataFrame, start: Column, end: Column, zone_name: Column, default_zone: str, out: str
) -> DataFrame:
    """Add a source date as destination instants plus the codes of what that loses."""
    zone = default_zone if default_zone in zoneinfo.available_timezones() else "UTC"
    named = df.withColumns({"_e": F.nullif(end, F.lit("")), "_n": F.nullif(zone_name, F.lit(""))})
    first = with_parsed_date(named, start, F.col("_n"), zone, "_first")
    both = with_parsed_date(first, F.col("_e"), F.col("_n"), zone, "_last")
    instant = lambda c: F.when(
        F.col(f"{c}.kind") == "date", date_only_epoch(F.col(f"{c}.day"), zone)
    ).otherwise(F.col(f"{c}.epoch_ms"))
    marked = both.withColumns(
        {
            "_bad": F.col("_first").isNull() | (F.col("_e").isNotNull() & F.col("_last").isNull()),
            "_assumed": F.coalesce("_first.assumed_zone", F.lit(False))
            | F.coalesce("_last.assumed_zone", F.lit(False)),
            "_start": instant("_first"),
            "_end": instant("_last"),
        }
    )
    good = ~F.col("_bad")
    told = lambda test, code: F.when(test, F.array(F.lit(code))).otherwise(F.array())
    codes = F.concat(
        told(F.col("_bad"), "DATE_UNPARSEABLE"),
        told(good & F.col("_n").isNotNull(), "DATE_TIMEZONE_NAME_NOT_PRESERVED"),
        told(good & F.col("_assumed"), "DATE_ASSUMED_TIMEZONE"),
    )
    timed = lambda c: F.when(good, F.col(f"{c}.kind") == "datetime")
    done = F.struct(
        F.when(good, F.col("_start")).alias("start_ms"), timed("_first").alias("start_timed"),
        F.when(good, F.col("_end")).alias("end_ms"), timed("_last").alias("end_timed"),
        F.col("_bad").alias("invalid"), codes.alias("codes"),
    )
    return marked.withColumn(out, done).drop("_e", "_n", "_first", "_last", "_bad", "_assumed", "_start", "_end")


def format_date_range(start: Column, end: Column, zone_name: Column) -> Column:
    zone = F.when(
        zone_name.isNotNull() & (zone_name != ""), F.concat(F.lit(" ("), zone_name, F.lit(")"))
    ).otherwise(F.lit(""))
    both = F.concat(start, F.lit(" → "), end, zone)
    return F.when(end.isNotNull() & (end != ""), both).otherwise(F.concat(start, zone))
