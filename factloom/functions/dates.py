"""Dates in texts, ages and decay as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import once

MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
# The one grammar of written dates: a form is an order of parts, with what may stand between them.
MONTH = f"(?:{'|'.join(MONTHS)})[a-z]*"
_PARTS = {"day": "[0-9]{1,2}", "nth": "[0-9]{1,2}(?:st|nd|rd|th)?", "number": "[0-9]{1,2}", "month": MONTH, "year": "[0-9]{4}", "short": "(?:[0-9]{4}|[0-9]{2})"}


def _form(told: str, between: str) -> str:
    """A pattern without groups: the named parts in their order, ``between`` each two."""
    return r"\b" + between.join(_PARTS[p] for p in told.split()) + r"\b"


_NUMERIC, _NAMED, _LED = _form("day number short", "[./-]"), _form("nth month year", r"[.,]?\s+"), _form("month nth year", r"[.,]?\s+")
ISO, SEASON = r"\b[0-9]{4}-[0-9]{2}-[0-9]{2}\b", _form("month year", r",?\s+")
#: Forms of a date, the longest first, so that what one form takes no other reads again.
DATE = f"(?:{'|'.join((ISO, _form('day number year', '[./-]'), _NAMED, _LED, SEASON))})"


def iso(found: Column) -> Column:
    """A written date in ISO form, to the day or else the month, from its numbers and the name of its month; day and month change places where the month is over 12."""
    two = lambda c: F.lpad(c.cast("string"), 2, "0")

    def told(parts: Column) -> Column:
        number, named = parts["number"], parts["named"]
        n = lambda i: F.get(number, F.lit(i))
        year = F.element_at(number, -1)
        year = F.when(F.length(year) == 2, F.concat(F.lit("20"), year)).otherwise(year)
        a, b = n(0).try_cast("int"), n(1).try_cast("int")
        return (
            F.when(F.length(n(0)) == 4, F.when(F.size(number) == 3, F.concat_ws("-", number)).otherwise(F.concat_ws("-", year, two(named))))
            .when(named > 0, F.concat_ws("-", year, two(named), two(n(0))))
            .otherwise(F.concat_ws("-", year, two(F.when(b > 12, a).otherwise(b)), two(F.when(b > 12, b).otherwise(a))))
        )

    number = F.regexp_extract_all(found, F.lit("[0-9]+"), F.lit(0))
    named = F.array_position(F.array(*map(F.lit, MONTHS)), F.substring(F.regexp_extract(found, MONTH, 0), 1, 3))
    return once(F.struct(number.alias("number"), named.alias("named")), told)


def dates(text: Column) -> Column:
    """All dates of a text in order, in ISO form (to the month where no day is stated); what is no day of the calendar goes."""
    found = F.transform(F.regexp_extract_all(F.lower(text), F.lit(DATE), F.lit(0)), iso)
    return F.filter(found, lambda d: F.when(F.length(d) == 10, F.try_to_date(d, "yyyy-MM-dd").isNotNull()).otherwise(True))


def _numeric(low: Column) -> Column:
    """A day before a month, both as numbers, in ISO form."""

    def told(n: Column) -> Column:
        day, month, year = (F.get(n, F.lit(i)) for i in range(3))
        year = F.when(F.length(year) == 2, F.concat(F.lit("20"), year)).otherwise(year)
        return F.concat_ws("-", year, F.lpad(month, 2, "0"), F.lpad(day, 2, "0"))

    return once(F.regexp_extract_all(low, F.lit("[0-9]+"), F.lit(0)), told)


def _first_of(text: Column, form: str) -> Column:
    """day and written of the first match of a form; null if there is none or it is no date."""
    told = _numeric if form == _NUMERIC else iso
    day = lambda found: F.when(found != "", F.try_to_date(told(F.lower(found)), "yyyy-MM-dd"))
    both = once(F.regexp_extract(text, f"(?i){form}", 0), lambda found: F.struct(day(found).alias("day"), found.alias("written")))
    return once(both, lambda x: F.when(x["day"].isNotNull(), x))


def micros(c: Column) -> Column:
    return F.unix_micros(c.cast("timestamp"))


def first_day(text: Column) -> Column:
    """day and written of the first d/m/y, else d Month y, else Month d y; a match that is no date counts as none; two-digit
    years are of this century.  A form is read only where those before it have no date."""
    return F.coalesce(*[_first_of(text, form) for form in (_NUMERIC, _NAMED, _LED)])


def first_date(text: Column) -> Column:
    return first_day(text)["day"]


def first_written(text: Column) -> Column:
    """What first_date() reads, as it is written."""
    return first_day(text)["written"]


def age(born: Column, at: Column) -> Column:
    """Completed years; a birthday on 29 February is not reached on the 28th."""
    early = (F.month(at) * 100 + F.dayofmonth(at)) < (F.month(born) * 100 + F.dayofmonth(born))
    return F.greatest(F.lit(0), F.year(at) - F.year(born) - early.cast("int"))


def decay(hours: Column, half_life: Column) -> Column:
    return F.pow(F.lit(2.0), -hours / half_life)


def stage(opens: Column, closes: Column, held: Column, now: Column) -> Column:
    """Where a cycle stands by its own dates, any of which may be missing."""
    after_close = F.when(held.isNotNull(), "PRE_EXAM").otherwise("APPLICATION_CLOSED")
    return F.when(now > held, "POST_EXAM").when(now > closes, after_close).when(now >= opens, "APPLICATION_OPEN").otherwise("BEFORE_NOTIFICATION")


def days_until(at: Column, now: Column) -> Column:
    """Whole days, rounded half up; negative once past."""
    return F.floor((micros(at) - micros(now)) / 86_400_000_000 + 0.5).cast("long")
