"""Values in cell text: dates, numbers, booleans, spreadsheet serials. Column expressions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Date shapes, with the groups of year, month, day and, where there is one, hour, minute, second.
DATE_SHAPES = (
    (r"(\d+)/(\d+)/(\d+) (\d+):(\d+):(\d+)", (3, 1, 2, 4, 5, 6)),
    (r"(\d+)\.(\d+)\.(\d+) (\d+):(\d+):(\d+)", (3, 2, 1, 4, 5, 6)),
    (r"(\d+)-(\d+)-(\d+) (\d+):(\d+):(\d+)", (1, 2, 3, 4, 5, 6)),
    (r"(\d+):(\d+):(\d+) (\d+)-(\d+)-(\d+)", (4, 5, 6, 1, 2, 3)),
    (r"(\d{4})(\d{2})(\d{2})-(\d{2})(\d{2})(\d{2})", (1, 2, 3, 4, 5, 6)),
    (r"(\d+)/(\d+)/(\d+)", (3, 1, 2)),
    (r"(\d+)\.(\d+)\.(\d+)", (3, 2, 1)),
    (r"(\d+)-(\d+)-(\d+)", (1, 2, 3)),
    (r"(\d{4})(\d{2})(\d{2})", (1, 2, 3)),
)
INT = r"^[+-]?[0-9]+$"
DOUBLE = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?[fFdD]?$"


def small_int(s: Column) -> Column:
    """Digits as an int, null beyond six of them: no field of a date is that long."""
    short = F.regexp_replace(s, "^0+(?=[0-9])", "")
    return F.when(F.length(short) <= 6, short).try_cast("int")


def full_year(y: Column) -> Column:
    return F.when(y < 30, y + 2000).when(y < 100, y + 1900).otherwise(y)


def _one(match: Column, pattern: str, groups: tuple[int, ...]) -> Column:
    part = [small_int(F.regexp_extract(match, pattern, g)) for g in groups]
    y, m, d = full_year(part[0]), part[1], part[2]
    leap = ((y % 4 == 0) & (y % 100 != 0)) | (y % 400 == 0)
    longest = F.when(m.isin(4, 6, 9, 11), 30).when(m == 2, F.when(leap, 29).otherwise(28)).otherwise(31)
    ok = y.between(0, 9999) & m.between(1, 12) & d.between(1, longest)
    text = F.format_string("%04d-%02d-%02d", y, m, d)
    if len(groups) == 6:
        ok &= part[3].between(0, 23) & part[4].between(0, 59) & part[5].between(0, 59)
        text = F.concat(text, F.format_string("T%02d:%02d:%02d", *part[3:]))
    return F.when(ok, text)


def parse_dates(text: Column) -> Column:
    """All dates and date-times of a text in XSD form, distinct and sorted. Years above 9999 are no dates."""

    def of(pattern: str, groups: tuple[int, ...]) -> Column:
        return F.array_compact(F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m: _one(m, pattern, groups)))

    found = F.sort_array(F.array_distinct(F.concat(*(of(p, g) for p, g in DATE_SHAPES))))
    none = F.array().cast("array<string>")
    return F.when(text.rlike(r"\d[/.:-]\d|\d{8}"), found).when(text.isNotNull(), none)


def dates_only(text: Column) -> Column:
    return F.filter(parse_dates(text), lambda x: ~x.contains(":"))


def datetimes_only(text: Column) -> Column:
    return F.filter(parse_dates(text), lambda x: x.contains(":"))


def parse_ints(text: Column) -> Column:
    """Integers of a text. A negative one that reads as a year (1960 to 2020) is the end of a range. What does not fit an int is dropped."""
    all_ = F.transform(F.regexp_extract_all(text, F.lit(r"[+-]?\d+"), F.lit(0)), lambda s: F.when(F.length(s) <= 18, s).try_cast("bigint"))
    fit = F.filter(all_, lambda v: v.between(-2147483648, 2147483647))
    return F.transform(fit, lambda v: F.when(v.between(-2020, -1960), -v).otherwise(v).cast("int"))


def parse_decimals(text: Column, locale: str = "en") -> Column:
    """Decimals of a text. The point stands for any character, as the shape is defined; what then is no number is dropped."""
    s = F.regexp_extract_all(text, F.lit(r"[+-]?\d+.\d+" if locale == "en" else r"[+-]?\d+,\d+"), F.lit(0))
    plain = F.transform(s, lambda x: F.replace(x, F.lit(","), F.lit(".")) if locale != "en" else x)
    return F.transform(F.filter(plain, lambda x: x.rlike(DOUBLE) & ~x.rlike("[fFdD]$")), lambda x: x.try_cast("double"))


def parse_boolean(cell_type: Column, text: Column, number: Column, boolean: Column, true_symbols: list[str], false_symbols: list[str]) -> Column:
    """An equal symbol decides, true ones first; then the more frequent side; a tie is null. Numbers 1 and 0 are true and false."""
    count = lambda symbols: sum((text.contains(s).cast("int") for s in symbols), F.lit(0))
    fuzzy = F.when(count(true_symbols) > count(false_symbols), True).when(count(true_symbols) < count(false_symbols), False)
    of_text = F.when(text.isin(*true_symbols), True).when(text.isin(*false_symbols), False).otherwise(fuzzy)
    return F.when(cell_type == "string", of_text).when(cell_type == "boolean", boolean).when(number == 1, True).when(number == 0, False)


def serial_to_date(serial: Column, windowing_1904: bool = False) -> Column:
    """Date of a spreadsheet serial; serials below 61 are a day off, for the leap day 1900 never had. Negative ones are null."""
    day = F.floor(serial).cast("int")
    if windowing_1904:
        return F.when(serial >= 0, F.date_add(F.lit("1904-01-01").cast("date"), day))
    return F.when(serial >= 0, F.date_add(F.lit("1899-12-30").cast("date"), day + F.when(day < 61, 1).otherwise(0)))


def serial_to_timestamp(serial: Column, windowing_1904: bool = False) -> Column:
    """Timestamp of a serial, to the nearest millisecond."""
    ms = F.floor((serial - F.floor(serial)) * 86400000 + 0.5)
    return F.timestamp_millis(F.unix_millis(serial_to_date(serial, windowing_1904).cast("timestamp")) + ms)


def date_to_serial(ts: Column, windowing_1904: bool = False) -> Column:
    """Serial of a timestamp; -1 before the first day that has one."""
    day = F.datediff(ts.cast("date"), F.lit("1904-01-01" if windowing_1904 else "1899-12-30").cast("date"))
    whole = day - (F.lit(0) if windowing_1904 else F.when(day < 61, 1).otherwise(0))
    part = (F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)) / F.lit(86400.0)
    return F.when(whole < (0 if windowing_1904 else 1), -1.0).otherwise(whole + part)


def convert_time(text: Column) -> Column:
    """Day fraction of HH:MM or HH:MM:SS, else null."""
    ok = text.rlike(r"^([01]?\d|2[0-3]):[0-5]\d(:[0-5]\d)?$")
    part = F.split(text, ":")
    second = F.coalesce(F.get(part, F.lit(2)), F.lit("0"))
    return F.when(ok, (F.get(part, F.lit(0)).try_cast("int") * 3600 + F.get(part, F.lit(1)).try_cast("int") * 60 + second.try_cast("int")) / F.lit(86400.0))


def is_date_format(fmt: Column) -> Column:
    """Whether a number format shows dates or times: only date letters and punctuation once literals, colours and conditions are gone."""
    bare = F.regexp_replace(fmt, r"\\.|\"[^\"]*\"|\[[^\]hHmMsS]*\]|;.*$|AM/PM|am/pm", "")
    return F.coalesce(bare.rlike(r"^[\[\]yYmMdDhHsSTJNn0-9\-T/,. :]+$") & bare.rlike("[yYmMdDhHsSTJN]"), F.lit(False))


#: Numbers of the built-in formats that show dates or times.
INTERNAL_DATE_FORMATS = (14, 15, 16, 17, 18, 19, 20, 21, 22, 45, 46, 47)


def is_internal_date_format(number: Column) -> Column:
    return number.isin(*INTERNAL_DATE_FORMATS)


def parse_day(text: Column) -> Column:
    """The date of YYYY/MM/DD, else null."""
    ok = text.rlike(r"^\d{4}/\d{1,2}/\d{1,2}$")
    part = F.split(text, "/")
    year, month, day = (F.get(part, F.lit(i)).try_cast("int") for i in range(3))
    return F.when(ok & (_one(text, r"(\d+)/(\d+)/(\d+)", (1, 2, 3)).isNotNull()), F.format_string("%04d-%02d-%02d", year, month, day)).try_cast("date")


def autodetect(text: Column, entity: Column) -> Column:
    """First date-time, else first date, else the entity, else the text."""
    return F.coalesce(F.get(datetimes_only(text), F.lit(0)), F.get(dates_only(text), F.lit(0)), entity, text)
