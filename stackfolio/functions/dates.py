"""Dates kept as text: partial dates, years before Christ and wrong days must survive."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

REAL_YEAR = r"(?:[01]\d{3}|20\d{2})"


def found(value: Column, pattern: str, group: int = 1) -> Column:
    """The first match, or NULL."""
    return F.nullif(F.regexp_extract(value, pattern, group), F.lit(""))


def start_year(statement: Column) -> Column:
    """First run of three or four digits."""
    return found(statement, r"(\d{3,4})")


def _padded(sign: Column, digits: Column) -> Column:
    return F.concat(F.when(sign == "v", "-").otherwise(""), F.lpad(digits, 4, "0"))


# One to four digits without leading zeros, or four digits below 3000; "v" marks years before Christ.
_LIFE_YEAR = r"(v?)([012]\d{3}|[1-9]\d{1,2}|\d)"


def birth_year(span: Column) -> Column:
    pattern = f"^{_LIFE_YEAR}-"
    return F.when(
        span.rlike(pattern),
        _padded(F.regexp_extract(span, pattern, 1), F.regexp_extract(span, pattern, 2)),
    )


def death_year(span: Column) -> Column:
    pattern = f"-{_LIFE_YEAR}$"
    return F.when(
        span.rlike(pattern),
        _padded(F.regexp_extract(span, pattern, 1), F.regexp_extract(span, pattern, 2)),
    )


def approximate_span(span: Column) -> Column:
    """The raw text, only where it is an approximate statement."""
    return F.when(span.rlike(r"^(?:ca\..*|.*Jh\.)$"), span)


def calendar_fix(date: Column) -> Column:
    """Days that a month does not have become its last day, ``yyyy-mm-dd`` only.

    29 February is kept in leap years of the 19th to 21st century only (1900 is none).
    """
    year = F.substring(date, 1, 4).try_cast("int")
    month_day = F.substring(date, 6, 5)
    leap = year.between(1800, 2099) & (year % 4 == 0) & (~year.isin(1800, 1900))
    head = F.substring(date, 1, 8)
    return (
        F.when(~date.rlike(r"^.{4}-\d\d-\d\d$"), date)
        .when((month_day == "02-29") & ~F.coalesce(leap, F.lit(False)), F.concat(head, F.lit("28")))
        .when(month_day.isin("02-30", "02-31"), F.concat(head, F.lit("28")))
        .when(month_day.isin("04-31", "06-31", "09-31", "11-31"), F.concat(head, F.lit("30")))
        .otherwise(date)
    )


def dotted_to_iso(value: Column) -> Column:
    return F.regexp_replace(value, r"(\d{2})\.(\d{2})\.(\d{4})", "$3-$2-$1")


def compact_to_iso(value: Column) -> Column:
    return F.regexp_replace(value, r"(\d{4})(\d{2})(\d{2})", "$1-$2-$3")


def without_date_marks(value: Column) -> Column:
    """Brackets and "circa" words of a date statement removed."""
    return F.regexp_replace(value, r"\[|\]|ca.[ ]?|c[ ]?|um[ ]?", "")


def publication_start(statement: Column) -> Column:
    """First realistic year of a cleaned statement; a statement with none gives NULL."""
    return F.when(
        statement.rlike(rf"^[^-]*?{REAL_YEAR}"), found(statement, rf"({REAL_YEAR})")
    )


def publication_end(statement: Column) -> Column:
    """Last realistic year behind a hyphen."""
    return found(statement, rf"^.*-.*({REAL_YEAR}).*$")


def as_year(date: Column) -> Column:
    return found(date, r"^(-?\d{1,4})").try_cast("int")
