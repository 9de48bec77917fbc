"""Column functions for times, local days and season text."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidelens import settings as S


def parse_ts(text: Column) -> Column:
    """DAT-01: timestamp from text ending in Z, +00 or +00:00; null when unreadable."""
    plain = F.regexp_replace(F.regexp_replace(text, "T", " "), r"(Z|\+00(:00)?)$", "")
    return F.try_to_timestamp(plain)


def local_day(ts: Column) -> Column:
    """DAT-02: calendar day at UTC-4."""
    return F.to_date(ts - F.expr("INTERVAL 4 HOURS"))


def local_day_end(day: Column) -> Column:
    """DAT-02: the instant the local day ends, in UTC."""
    return F.date_add(day, 1).cast("timestamp") + F.expr("INTERVAL 4 HOURS")


def millis_to_iso(ms: Column) -> Column:
    """DAT-03: ISO text of epoch milliseconds; null on bad input."""
    number = ms.try_cast("double")
    stamp = F.timestamp_millis(F.floor(number).cast("bigint"))
    return F.date_format(stamp, "yyyy-MM-dd'T'HH:mm:ss'+00:00'")


def cyclic(value: Column, period: float) -> tuple[Column, Column]:
    """DAT-04: (sin, cos) of a position in a cycle."""
    angle = value.cast("double") * (2 * math.pi / period)
    return F.sin(angle), F.cos(angle)


def overpass_time(day: Column) -> Column:
    """DAT-05: fixed time a dated cluster stands for (17:30 UTC)."""
    return F.to_date(day).cast("timestamp") + F.expr("INTERVAL 17 HOURS 30 MINUTES")


def valid_at(run_at: Column, hours: Column) -> Column:
    """DAT-07: run time plus a horizon in hours."""
    return F.timestamp_add("HOUR", hours.cast("int"), run_at)


def regime(days_ahead: Column) -> Column:
    """DAT-08: which forecast answers for a day this far ahead."""
    return (F.when(days_ahead.between(0, 3), "physics")
            .when(days_ahead.between(4, 21), "extended")
            .otherwise("seasonal"))


def local_stamp(ts: Column, pattern: str = "dd MMM HH:mm", suffix: str = " AST") -> Column:
    """DAT-09: local arrival text, empty when unknown."""
    text = F.concat(F.date_format(ts - F.expr("INTERVAL 4 HOURS"), pattern), F.lit(suffix))
    return F.coalesce(text, F.lit(""))


def _month_number(word: Column) -> Column:
    """Month of a word by its first three letters; null when none matches.

    A word of one or two letters matches the first month that begins with it.
    """
    w = F.lower(F.regexp_replace(F.trim(word), r"[.,;)]+$", ""))
    out = F.lit(None).cast("int")
    for number, name in reversed(list(enumerate(S.MONTHS, start=1))):
        out = F.when((F.length(w) > 0) & F.lit(name).startswith(F.substring(w, 1, 3)), F.lit(number)).otherwise(out)
    return out


def good_in_month(text: Column, month: Column | int) -> Column:
    """DAT-06: does a month fall inside a season text?

    This is the documented range rule: windows are joined by "&" or "and", a window is one month
    or two joined by a dash or the word "to", ranges may wrap over December, empty or year-round
    text is always good and text with no readable month never is. A published implementation
    splits inside words that hold "t" or "o" ("October" becomes "c" and "ber"), so such texts
    read differently there; that quirk is not reproduced.
    """
    m = month if isinstance(month, Column) else F.lit(int(month))
    low = F.lower(F.coalesce(text, F.lit("")))
    segments = F.split(F.regexp_replace(low, " and ", " & "), "&")
    # str-valued helpers keep the whole parse inside one higher-order expression
    numbers = lambda seg: F.filter(
        F.transform(F.split(F.trim(F.split(seg, r"\(")[0]), r"\s*[–—/-]+\s*|\s+to\s+"), _month_number),
        lambda n: n.isNotNull())
    in_window = lambda lo, hi: F.when(lo <= hi, (m >= lo) & (m <= hi)).otherwise((m >= lo) | (m <= hi))
    hit = lambda seg: (F.when(F.size(numbers(seg)) >= 2,
                              in_window(F.get(numbers(seg), F.lit(0)), F.get(numbers(seg), F.lit(1))))
                       .when(F.size(numbers(seg)) == 1, F.get(numbers(seg), F.lit(0)) == m)
                       .otherwise(F.lit(False)))
    always = (low == "") | low.contains("year") | low.contains("todo el año")
    return always | F.exists(segments, hit)
