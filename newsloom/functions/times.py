"""Dates of feeds and saved pages, ages, and weights that decay with age."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from newsloom.functions.text import text_of

ISO = "yyyy-MM-dd'T'HH:mm:ss'Z'"
SAVED_DATE = "^\\s*\\w+, (\\d+) (\\w+) (\\d{4}) (\\d+):(\\d+):(\\d+) GMT([+-])(\\d+)(?::?(\\d\\d))?"

# Zones that mail and feeds call by name.
ZONES = {
    "GMT": "+0000", "UTC": "+0000", "UT": "+0000", "Z": "+0000", "AST": "-0400", "ADT": "-0300", "EST": "-0500", "EDT": "-0400",
    "CST": "-0600", "CDT": "-0500", "MST": "-0700", "MDT": "-0600", "PST": "-0800", "PDT": "-0700", "JST": "+0900",
}


def feed_time(text: str | Column) -> Column:
    """An RFC 822 time (zones by name or offset, years of two or four digits) or an ISO 8601 time, or null."""
    t = F.regexp_replace(F.trim(text_of(text)), "^[A-Za-z]+,\\s*", "")
    t = F.regexp_replace(t, "^(\\d{1,2} +[A-Za-z]{3}) +([0-6]\\d) ", "$1 20$2 ")
    t = F.regexp_replace(t, "^(\\d{1,2} +[A-Za-z]{3}) +([7-9]\\d) ", "$1 19$2 ")
    zone = F.upper(F.regexp_extract(t, "[\\d ]([A-Za-z]{1,4})$", 1))
    offset = F.element_at(F.create_map(*[F.lit(x) for kv in ZONES.items() for x in kv]), zone)
    t = F.when(offset.isNotNull(), F.concat(F.regexp_replace(t, " *[A-Za-z]+$", ""), F.when(t.rlike("^\\d{4}-"), "").otherwise(" "), offset)).otherwise(t)
    t = F.regexp_replace(t, "([+-]\\d\\d):(\\d\\d)$", "$1$2")
    forms = ("d MMM yyyy HH:mm:ss Z", "d MMM yyyy HH:mm Z", "yyyy-MM-dd'T'HH:mm:ssZ", "yyyy-MM-dd'T'HH:mm:ss.SSSZ", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd")
    return F.coalesce(*[F.try_to_timestamp(t, F.lit(f)) for f in forms])


def entry_time(published: str | Column, updated: str | Column) -> Column:
    return F.coalesce(feed_time(published), feed_time(updated))


def saved_date(text: str | Column) -> Column:
    """'Thu, 24 Sep 2026 22:15:16 GMT-4' -> '2026-09-25T02:15:16Z'; hour 24 is hour 0 of the same day; else ""."""
    s = text_of(text)
    parts = F.split(F.regexp_replace(s, f"(?s){SAVED_DATE}.*", "$1 $2 $3/$4/$5/$6/$7/$8/$9"), "/")

    def said(part: Column) -> Column:
        number = lambda i: F.coalesce(F.get(part, F.lit(i)).try_cast("int"), F.lit(0))
        day = F.try_to_timestamp(F.get(part, F.lit(0)), F.lit("d MMM yyyy"))
        seconds = (number(1) % 24) * 3600 + number(2) * 60 + number(3)
        ahead = (number(5) * 3600 + number(6) * 60) * F.when(F.get(part, F.lit(4)) == "-", -1).otherwise(1)
        return F.date_format(F.timestamp_seconds(F.unix_seconds(day) + seconds - ahead), ISO)

    # a transform of one element: its parts are found once, however often they are named
    return F.when(s.rlike(SAVED_DATE), F.coalesce(F.element_at(F.transform(F.array(parts), said), 1), F.lit(""))).otherwise("")


def parse_day(iso: str | Column) -> Column:
    return F.try_to_date(F.left(text_of(iso), F.lit(10)), "yyyy-MM-dd")


def decayed(age_days: Column, half_life: float) -> Column:
    return F.pow(F.lit(0.5), age_days / F.lit(float(half_life)))


def age_hours(published: Column, now: Column) -> Column:
    """Hours since then, not below 0; 0 for null."""
    return F.coalesce(F.greatest(F.lit(0.0), (now.cast("double") - published.cast("double")) / 3600), F.lit(0.0))
