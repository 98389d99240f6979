"""Numbers, dates, units, keys and periods."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import clean

EXACT = "decimal(38,18)"


def parse_decimal(x: Column) -> Column:
    """Exact number, or null; thousands marks, dollar signs and one percent sign are ignored."""
    bare = F.regexp_replace(F.regexp_replace(clean(x), r"[,$\s]", ""), "%$", "")
    return F.when(~bare.isin("", "-", "+", "."), bare).try_cast(EXACT)


def parse_int(x: Column) -> Column:
    d = parse_decimal(x)
    return F.when(d < 0, F.ceil(d)).otherwise(F.floor(d)).cast("int")


def parse_date(x: Column) -> Column:
    c = clean(x)
    return F.coalesce(*(F.to_date(F.try_to_timestamp(c, F.lit(f))) for f in ("yyyy-MM-dd", "MM/dd/yyyy", "yyyy/MM/dd")))


def excel_date(serial: Column) -> Column:
    """Spreadsheet day number (day 1 is 1899-12-31) as a date."""
    return F.date_add(F.lit("1899-12-30").cast("date"), serial.cast("int"))


def identifier(x: Column) -> Column:
    return F.regexp_replace(clean(x), r"\.0+$", "")


def tracking_id(x: Column) -> Column:
    """PREFIX.0123 as PREFIX.123; other texts are null."""
    c = F.upper(clean(x))
    return F.concat(F.nullif(F.regexp_extract(c, r"^([A-Z]+)\.0*([0-9]+)$", 1), F.lit("")), F.lit("."), F.regexp_extract(c, r"^([A-Z]+)\.0*([0-9]+)$", 2))


def split_ids(x: Column, separator: str = ";") -> Column:
    return F.array_sort(F.array_distinct(F.filter(F.transform(F.split(x, separator), clean), lambda v: v.isNotNull())))


def convert(value: Column, unit: Column) -> tuple[Column, Column]:
    """Value and unit in canonical units: hours as days, thousands of dollars as dollars,
    fractions as percent unless already above one."""
    v = (
        F.when(unit == "hours", value / 24)
        .when(unit == "$1,000", value * 1000)
        .when((unit == "fraction") & (F.abs(value) <= 1), value * 100)
        .otherwise(value)
    )
    u = F.when(unit == "hours", F.lit("days")).when(unit == "$1,000", F.lit("dollars")).when(unit == "fraction", F.lit("percent")).otherwise(unit)
    return v, u


def stable_hash(prefix: str, n: int, *parts: Column) -> Column:
    return F.concat(F.lit(prefix), F.substring(F.sha1(F.concat_ws("|", *parts)), 1, n))


def identity(own: Column, table: str, parts: list[Column], ordinal: Column) -> Column:
    """A row's own id, else a hash of its parts, else its ordinal."""
    joined = F.nullif(F.concat_ws("|", *parts), F.lit(""))
    return F.coalesce(clean(own), F.concat(F.lit(f"T{table}-R-"), F.substring(F.sha1(joined), 1, 16)), F.concat(F.lit(f"T{table}-N-"), ordinal.cast("string")))


def period_label(year: Column, quarter: Column) -> Column:
    return F.concat(year.cast("string"), F.lit("-Q"), quarter.cast("string"))


def period_end(year: Column, quarter: Column) -> Column:
    return F.last_day(F.make_date(year, quarter * 3, F.lit(1)))


def relative_close(a: Column, b: Column, tolerance: float = 1e-6) -> Column:
    return F.abs(a - b) <= tolerance * F.greatest(F.lit(1.0), F.abs(a), F.abs(b))


def plain(x: Column) -> Column:
    """Number without trailing zeros; null as a dash."""
    text = x.cast("string")
    return F.coalesce(F.when(text.contains("."), F.regexp_replace(F.regexp_replace(text, "0+$", ""), r"\.$", "")).otherwise(text), F.lit("—"))


def numeric_variants(x: Column) -> Column:
    """Ways in which prose may print an exact number: as it is stored, without trailing zeros, and,
    of a whole number, in thousands; of any other, at one, two and three digits (half to even),
    with and without thousands."""
    exact = x.cast("string")
    trimmed = F.when(F.contains(exact, F.lit(".")), F.regexp_replace(exact, r"\.?0+$", "")).otherwise(exact)
    bare = lambda d: F.replace(F.format_number(x, d), F.lit(","), F.lit(""))
    whole = F.array(F.format_number(x, 0), bare(0))
    parts = F.array(*(f(d) for d in (1, 2, 3) for f in (lambda d: F.format_number(x, d), bare)))
    return F.array_distinct(F.concat(F.array(exact, trimmed), F.when(x == F.floor(x), whole).otherwise(parts)))


def column_index(letters: Column) -> Column:
    """A is 0, AA is 26."""
    return F.aggregate(F.transform(F.split(F.upper(letters), ""), lambda c: F.ascii(c) - 64), F.lit(0), lambda a, v: F.when(v > 0, a * 26 + v).otherwise(a)) - 1


def column_letters(index: Column) -> Column:
    """Inverse of column_index, up to three letters (18,278 columns)."""
    n = index + 1
    letter = lambda v: F.char((v % 26 + 65).cast("int"))
    one, two = letter(n - 1), F.concat(letter(F.floor((n - 27) / 26)), letter(n - 27))
    rest = n - 703
    three = F.concat(letter(F.floor(rest / 676)), letter(F.floor(rest / 26)), letter(rest))
    return F.when(n <= 26, one).when(n <= 702, two).otherwise(three)
