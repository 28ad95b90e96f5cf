"""Dates from noisy digit strings. A date that its digits don't settle is refused or flagged."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vocabulary as V
from .text import clean, let, lookup

_MONTH = "|".join(sorted(V.MONTHS, key=len, reverse=True))
_DAY_MONTH_YEAR = rf"(?i)\b(\d{{1,2}})(?:st|nd|rd|th)?[\s,.\-]+({_MONTH})[\s,.\-]+(\d{{2,4}})\b"
_MONTH_DAY_YEAR = rf"(?i)\b({_MONTH})[\s,.\-]+(\d{{1,2}})(?:st|nd|rd|th)?[\s,.\-]+(\d{{2,4}})\b"
_ISO = r"\b(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})\b"


def _int(c: Column) -> Column:
    return c.try_cast("int")


def date_of(year: Column, month: Column, day: Column) -> Column:
    """The date, years below 70 in 2000s and below 100 in 1900s; null if there is no such day."""

    def made(y: Column, m: Column, d: Column) -> Column:
        leap = ((y % 4 == 0) & (y % 100 != 0)) | (y % 400 == 0)
        days = F.when(m == 2, F.when(leap, 29).otherwise(28)).when(m.isin(4, 6, 9, 11), 30).otherwise(31)
        return F.when(y.between(1, 9999) & m.between(1, 12) & (d >= 1) & (d <= days), F.make_date(y, m, d))

    # the parts are regular expressions mostly: each is evaluated once
    pivot = lambda x: F.when(x["y"] < 70, x["y"] + 2000).when(x["y"] < 100, x["y"] + 1900).otherwise(x["y"])
    return let(F.struct(year.alias("y"), month.alias("m"), day.alias("d")), lambda x: let(pivot(x), lambda y: made(y, x["m"], x["d"])))


def _result(value: Column, status: Column, note: Column) -> Column:
    return F.struct(value.alias("value"), status.alias("status"), note.alias("note"))


def _ok(value: Column) -> Column:
    return _result(value, F.lit(V.OK), F.lit(None).cast("string"))


def _refused(note: Column) -> Column:
    return _result(F.lit(None).cast("date"), F.lit(V.UNPARSEABLE), note)


def six_digits(digits: Column) -> Column:
    """struct<value, status, note> of DDMMYY, MMDDYY and YYMMDD readings: resolved if the valid ones agree."""
    a, b, c = (_int(F.substring(digits, i, 2)) for i in (1, 3, 5))
    readings = (("DDMMYY", date_of(c, b, a)), ("MMDDYY", date_of(c, a, b)), ("truncated-YYYYMMDD", date_of(a, b, c)))
    every = F.filter(F.array(*[F.struct(d.alias("d"), F.lit(n).alias("label")) for n, d in readings]), lambda x: x["d"].isNotNull())

    def judge(valid: Column) -> Column:
        days = F.array_sort(F.array_distinct(F.transform(valid, lambda x: x["d"])))
        labels = lambda d: F.array_join(F.transform(F.filter(valid, lambda x: x["d"] == d), lambda x: x["label"]), "/")
        listed = F.array_join(F.transform(days, lambda d: F.concat(d.cast("string"), F.lit(" ("), labels(d), F.lit(")"))), ", ")
        one = F.get(days, F.lit(0))
        return (
            F.when(F.size(days) == 1, _result(one, F.lit(V.OK), F.concat(F.lit("six digits read as "), labels(one))))
            .when(F.size(days) > 1, _refused(F.concat(F.lit("six digits with several readings: "), listed)))
            .otherwise(_refused(F.lit("six digits without a valid reading")))
        )

    return let(every, judge)


def _eight_digits(digits: Column, prefer: str) -> Column:
    at = lambda i, n: _int(F.substring(digits, i, n))
    ymd, dmy, mdy = date_of(at(1, 4), at(5, 2), at(7, 2)), date_of(at(5, 4), at(3, 2), at(1, 2)), date_of(at(5, 4), at(1, 2), at(3, 2))

    def judge(x: Column) -> Column:
        ymd, dmy, mdy = x["ymd"], x["dmy"], x["mdy"]
        chosen, other = (dmy, mdy) if prefer == "DMY" else (mdy, dmy)
        resolved = F.coalesce(dmy, mdy, ymd)
        return (
            F.when(F.coalesce(dmy != mdy, F.lit(False)), _result(chosen, F.lit(V.AMBIGUOUS), F.concat(F.lit("could also read as "), other.cast("string"))))
            .when(resolved.isNotNull(), _ok(resolved))
            .otherwise(_refused(F.lit("no valid calendar date")))
        )

    return let(F.struct(ymd.alias("ymd"), dmy.alias("dmy"), mdy.alias("mdy")), judge)


def parse_date(raw: Column, prefer: str = "DMY", unicode: bool = True) -> Column:
    """struct<value, raw_text, status, note>: ISO, then month names, then six or eight digits."""

    def parts(text: Column, pattern: str, order: tuple[int, int, int]) -> Column:
        y, m, d = (F.regexp_extract(text, pattern, i) for i in order)
        month = let(m, lambda m: F.coalesce(_int(m), lookup(V.MONTHS, F.lower(m))))
        return F.when(text.rlike(pattern), date_of(_int(y), month, _int(d)))

    def digits(text: Column) -> Column:
        d = F.regexp_replace(F.regexp_replace(text, r"(?i)\b[DMY]{1,4}\b", " "), r"\D", "")
        return let(
            d,
            lambda d: F.when(F.length(d) == 6, six_digits(d))
            .when(F.length(d) == 8, _eight_digits(d, prefer))
            .otherwise(_refused(F.concat(F.lit("expected 8 digits, got "), F.length(d).cast("string")))),
        )

    def read(text: Column) -> Column:
        known = F.coalesce(parts(text, _ISO, (1, 2, 3)), parts(text, _DAY_MONTH_YEAR, (3, 2, 1)), parts(text, _MONTH_DAY_YEAR, (3, 1, 2)))
        found = let(known, lambda k: F.when(k.isNotNull(), _ok(k)).otherwise(digits(text)))
        empty = _result(F.lit(None).cast("date"), F.lit(V.ABSENT), F.lit(None).cast("string"))
        full = let(F.when(text == "", empty).otherwise(found), lambda r: F.struct(r["value"].alias("value"), F.when(text == "", raw).otherwise(text).alias("raw_text"), r["status"].alias("status"), r["note"].alias("note")))
        return full

    return let(clean(raw, unicode), read)


def months_between(today: Column, written: Column) -> Column:
    """Whole months from written to today, both ways as calendars count them."""
    m = (F.year(today) - F.year(written)) * 12 + F.month(today) - F.month(written)
    return m - F.when(F.add_months(written, m) > today, 1).otherwise(0)
