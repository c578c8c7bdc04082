"""Text to typed columns. Every expression yields NULL where the text is bad."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerloom.schema import MONEY

ISO_DAY = r"^\d{4}-\d{1,2}-\d{1,2}$"

# Further date patterns, tried in this order.
DATE_PATTERNS = [
    "yyyy/M/d",
    "yyyy.M.d",
    "MMM d, yyyy",
    "MMMM d, yyyy",
    "d MMM yyyy",
    "d MMMM yyyy",
    "d-MMM-yyyy",
    "yyyyMMdd",
    "yyyy-M",
    "yyyy-M-d H:m[:s[.SSSSSS]]",
    "yyyy-M-d'T'H:m[:s[.SSSSSS]]",
]
# Numbers joined by slashes or hyphens, by the order of month and day.
MONTH_FIRST = ["M/d/yyyy[ H:m[:s]]", "M-d-yyyy", "M/d/yy"]
DAY_FIRST = ["d/M/yyyy[ H:m[:s]]", "d-M-yyyy", "d/M/yy"]
NUMBERS_ONLY = r"^\d{1,2}[/-]\d{1,2}[/-]\d"

# What a file whose dates can be read in both orders is read as: "month" or "day" first. With
# "only" the other order is not a date at all.
DATE_ORDERS = ["month", "day", "month only", "day only"]

# All white space of Unicode, the control characters that part records included.
WHITE_SPACE = (
    " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
# A zone at the end of a time; the day is the one written.
ZONE = r"(?<=[0-9])\s?(Z|[+-][0-9]{2}:?[0-9]{2})$"

# Cell texts that mean "no value".
MISSING_TEXTS = [
    "",
    "#N/A",
    "#N/A N/A",
    "#NA",
    "-1.#IND",
    "-1.#QNAN",
    "-NaN",
    "-nan",
    "1.#IND",
    "1.#QNAN",
    "<NA>",
    "N/A",
    "NA",
    "NULL",
    "NaN",
    "None",
    "n/a",
    "nan",
    "null",
]


def stripped(text: Column) -> Column:
    """Without white space of any kind at either end, in time linear in the text."""
    return F.btrim(text, F.lit(WHITE_SPACE))


def strict_date(text: Column) -> Column:
    """Year, month and day joined by hyphens only."""
    return F.when(text.rlike(ISO_DAY), text.try_cast("date"))


def _read_by(text: Column, patterns: list[str]) -> Column:
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(p)).cast("date") for p in patterns])


def date_readings(text: Column) -> tuple[Column, Column, Column]:
    """(date, day-first date, whether the order of month and day is open).

    The usual form is a plain cast; only other texts go through the pattern parsers. Where the
    order is open the first date is read month first; elsewhere the second one is null.
    """
    trimmed = stripped(text)
    timed = F.when(trimmed.contains(":"), F.regexp_replace(trimmed, ZONE, "")).otherwise(trimmed)
    numbers = F.coalesce(trimmed.rlike(NUMBERS_ONLY), F.lit(False))
    date = (
        F.when(trimmed.rlike(ISO_DAY), trimmed.try_cast("date"))
        .when(numbers, _read_by(timed, MONTH_FIRST))
        .otherwise(_read_by(timed, DATE_PATTERNS))
    )
    return date, F.when(numbers, _read_by(timed, DAY_FIRST)), numbers


def _number(text: Column, kind) -> Column:
    """A plain cast, which passes over usual blanks; only where it fails is more stripped."""
    return F.coalesce(text.try_cast(kind), stripped(text).try_cast(kind))


def money(text: Column) -> Column:
    """Exact amount; infinity, NaN and grouped digits are not amounts."""
    return _number(text, MONEY)


def whole_number(text: Column) -> Column:
    """Integer, fractions cut off toward zero."""
    return F.coalesce(_number(text, "bigint"), _number(text, "decimal(38,18)").try_cast("bigint"))


def strict_whole_number(text: Column) -> Column:
    """Integer text only; an empty cell counts as zero."""
    return F.when(F.coalesce(text, F.lit("")) == "", F.lit(0).cast("bigint")).otherwise(F.trim(text).try_cast("bigint"))


def department(text: Column) -> Column:
    """Trimmed name; NULL when there is none."""
    trimmed = stripped(text)
    return F.when(~trimmed.isin(MISSING_TEXTS), trimmed)
