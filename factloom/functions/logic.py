"""Three-valued verdicts OK, FAIL and UNKNOWN as columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

OK, FAIL, UNKNOWN = "OK", "FAIL", "UNKNOWN"


def judge(test: Column) -> Column:
    """A boolean as a verdict; null is not known."""
    return F.when(test, OK).when(~test, FAIL).otherwise(UNKNOWN)


def _any(states: tuple[Column, ...], state: str) -> Column:
    return reduce(lambda a, b: a | b, [s == state for s in states])


def all_of(*states: Column) -> Column:
    """FAIL beats UNKNOWN beats OK; no rule at all is not known."""
    if not states:
        return F.lit(UNKNOWN)
    return F.when(_any(states, FAIL), FAIL).when(_any(states, UNKNOWN), UNKNOWN).otherwise(OK)


def any_of(*states: Column) -> Column:
    if not states:
        return F.lit(UNKNOWN)
    return F.when(_any(states, OK), OK).when(_any(states, UNKNOWN), UNKNOWN).otherwise(FAIL)
