"""Dates inferred from paths, as native expressions.

A name is cut into runs of digits and what stands between them, a path into folders and into words. Neighbours among
these are read together; every reading is made a date if it is one, and the first that is stays.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lumenfold.functions.paths import basename

FIRST_YEAR, LAST_YEAR = 1990, 2035

#: Month names and their short forms.
MONTHS = {
    "january": 1, "february": 2, "march": 3, "april": 4, "may": 5, "june": 6, "july": 7, "august": 8, "september": 9,
    "october": 10, "november": 11, "december": 12, "jan": 1, "feb": 2, "mar": 3, "apr": 4, "jun": 6, "jul": 7, "aug": 8,
    "sep": 9, "sept": 9, "oct": 10, "nov": 11, "dec": 12,
}


def _stamp(y: Column, m: Column, d: Column, clock: Column | None = None) -> Column:
    """YYYY-MM-DD hh:mm:ss of a valid date in range, else null. No clock is noon."""
    y, m, d = (x.try_cast("int") for x in (y, m, d))
    day = F.try_make_timestamp_ntz(y, m, d, F.lit(0), F.lit(0), F.lit(0))
    good = day.isNotNull() & y.between(FIRST_YEAR, LAST_YEAR)
    return F.when(good, F.concat(F.date_format(day, "yyyy-MM-dd"), F.lit(" "), clock if clock is not None else F.lit("12:00:00")))


def _readings(parts: Column, width: int, read, first: int = 0) -> Column:
    """The first date that ``read`` makes of ``width`` neighbours among ``parts``; neighbours past the end are null."""
    places = F.when(F.size(parts) > first, F.sequence(F.lit(first), F.size(parts) - 1))
    found = F.filter(F.transform(places, lambda i: read(*[F.get(parts, i + k) for k in range(width)])), lambda x: x.isNotNull())
    return F.try_element_at(found, F.lit(1))


def _is_year(x: Column) -> Column:
    return (F.length(x) == 4) & (x.startswith("19") | x.startswith("20")) & x.rlike("^[0-9]+$")


def _is_day(x: Column) -> Column:
    """A month's or a day's number."""
    return x.rlike("^[0-9]{1,2}$")


def _run(x: Column, gap: Column, after: Column) -> Column:
    """A run of digits: a date, or a date with its clock; the clock may follow after one mark."""
    clocked = (F.length(x) == 8) & gap.isin("_", "-") & F.length(after).isin(4, 6)
    digits = F.when(clocked, F.concat(x, after)).otherwise(x)
    h, m = F.substring(digits, 9, 2), F.substring(digits, 11, 2)
    s = F.when(F.length(digits) == 14, F.substring(digits, 13, 2)).otherwise("00")
    on_clock = (F.length(digits) > 8) & (h < "24") & (m < "60") & (s < "60")
    clock = F.when(on_clock, F.concat_ws(":", h, m, s)).otherwise("12:00:00")
    good = _is_year(F.substring(x, 1, 4)) & F.length(x).isin(8, 12, 14)
    return F.when(good, _stamp(F.substring(digits, 1, 4), F.substring(digits, 5, 2), F.substring(digits, 7, 2), clock))


def _marked(y: Column, mark: Column, m: Column, other: Column, d: Column) -> Column:
    """Three runs of digits with one mark between them."""
    return F.when(_is_year(y) & mark.isin(".", "_", "-") & _is_day(m) & other.isin(".", "_", "-") & _is_day(d), _stamp(y, m, d))


def _folders_day(y: Column, m: Column, d: Column, below: Column) -> Column:
    return F.when(_is_year(y) & _is_day(m) & _is_day(d) & below.isNotNull(), _stamp(y, m, d))


def _folders_month(y: Column, m: Column, below: Column) -> Column:
    return F.when(_is_year(y) & _is_day(m) & below.isNotNull(), _stamp(y, m, F.lit("1")))


def _first_run(name: Column) -> Column:
    """The leftmost run of digits that looks like a date, if it is one: most names need no other reading."""
    pattern = "(?<![0-9])((?:19|20)[0-9]{6})([0-9]{4}(?:[0-9]{2})?)?(?![0-9])(?:[_-]([0-9]{6}|[0-9]{4})(?![0-9]))?"
    day, joined, behind = (F.regexp_extract(name, pattern, i) for i in (1, 2, 3))
    digits = F.when(joined != "", joined).otherwise(behind)
    # Hours, minutes and seconds in range, which are there or noon.
    good = digits.rlike("^([01][0-9]|2[0-3])([0-5][0-9]){1,2}$")
    clock = F.when(good, F.regexp_replace(F.rpad(digits, 6, "0"), "^(..)(..)(..)$", "$1:$2:$3")).otherwise("12:00:00")
    return F.when(name.rlike(pattern), _stamp(F.substring(day, 1, 4), F.substring(day, 5, 2), F.substring(day, 7, 2), clock))


def _first_marked(name: Column) -> Column:
    pattern = "(?<![0-9])((?:19|20)[0-9]{2})[._-]([0-9]{1,2})[._-]([0-9]{1,2})(?![0-9])"
    return F.when(name.rlike(pattern), _stamp(*[F.regexp_extract(name, pattern, i) for i in (1, 2, 3)]))


def _first_folders(path: Column, n: int) -> Column:
    """The leftmost folders of a date's ``n`` parts, if they are a date: most paths need no other reading."""
    pattern = "/((?:19|20)[0-9]{2})" + "/([0-9]{1,2})" * (n - 1) + "/"
    y, m, d = (F.regexp_extract(path, pattern, i) if i <= n else F.lit("1") for i in (1, 2, 3))
    return F.when(path.rlike(pattern), _stamp(y, m, d))


def _month_at_end(word: Column) -> Column:
    """The month that a word ends with, as a word of its own, with a full stop or without."""
    table = F.create_map(*[F.lit(v) for pair in MONTHS.items() for v in pair])
    return F.try_element_at(table, F.lower(F.regexp_extract(word, r"([\p{L}\p{N}_]*)\.?$", 1)))


def _year_in_front(word: Column) -> Column:
    return F.nullif(F.regexp_extract(word, r"^([0-9]{4})(?![\p{L}\p{N}_])", 1), F.lit(""))


def _words_day(a: Column, b: Column, c: Column) -> Column:
    year, day = _year_in_front(c), F.regexp_extract(F.lower(b), r"^([0-9]{1,2})(st|nd|rd|th)?,?$", 1)
    return F.when(_is_year(year) & (day != ""), _stamp(year, _month_at_end(a), day))


def _words_month(a: Column, b: Column) -> Column:
    year = _year_in_front(b)
    return F.when(_is_year(year), _stamp(year, _month_at_end(a), F.lit("1")))


def _epoch(name: Column) -> Column:
    """A name that begins with thirteen digits of milliseconds, read in UTC whatever the session's zone."""
    ms = F.nullif(F.regexp_extract(name, r"^(\d{13})(?:\D|$)", 1), F.lit("")).try_cast("bigint")
    # A civil date from days since 1970, so that no time zone has a part.
    days, second = F.floor(ms / 86_400_000).cast("int"), F.floor(ms / 1000) % 86_400
    day = F.date_add(F.lit("1970-01-01").cast("date"), days)
    clock = F.format_string("%02d:%02d:%02d", F.floor(second / 3600), F.floor(second / 60) % 60, second % 60)
    return F.when(ms.isNotNull() & F.year(day).between(FIRST_YEAR, LAST_YEAR), F.concat(F.date_format(day, "yyyy-MM-dd"), F.lit(" "), clock))


def infer_date(path: Column) -> Column:
    """The date that a path tells, by name, by milliseconds, by folders or by month names; else null."""
    name = basename(path)
    runs = F.regexp_extract_all(name, F.lit(r"[0-9]+|[^0-9]+"), F.lit(0))  # digits and other marks in turn
    folders, words = F.split(path, "/"), F.split(path, r"\s+")
    # A pattern says first whether a reading can find anything at all.
    year = "(19|20)[0-9]{2}"
    return F.coalesce(
        _first_run(name),
        F.when(name.rlike(f"{year}[0-9]{{4}}"), _readings(runs, 3, _run)),
        _first_marked(name),
        F.when(name.rlike(f"{year}[._-][0-9]{{1,2}}[._-][0-9]"), _readings(runs, 5, _marked)),
        _epoch(name),
        _first_folders(path, 3),
        F.when(path.rlike(f"/{year}/[0-9]{{1,2}}/[0-9]{{1,2}}/"), _readings(folders, 4, _folders_day, first=1)),
        F.when(path.rlike(rf"\s{year}"), _readings(words, 3, _words_day)),
        _first_folders(path, 2),
        F.when(path.rlike(f"/{year}/[0-9]{{1,2}}/"), _readings(folders, 3, _folders_month, first=1)),
        F.when(path.rlike(rf"\s{year}"), _readings(words, 2, _words_month)),
    )
