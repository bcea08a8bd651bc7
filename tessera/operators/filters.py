"""Catalogue filters as Column predicates; every ``now`` is an ``as_of`` given by the caller."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the service: codes for how a filter parameter is read.
PROCESS_FUTURE, PROCESS_RUNNING, PROCESS_ENDED = 1, 2, 3
#: Owner of the platform's own courses; a deployment sets its own.
OWN_PLATFORM = "platform"


def _at(as_of: datetime | str) -> Column:
    return F.lit(str(as_of)).cast("timestamp_ntz")


def one_or_many(c: str, value) -> Column | None:
    """A list means any of it, a string equality, anything else no filter."""
    if isinstance(value, (list, tuple, set)):
        return F.col(c).isin(list(value))
    return F.col(c) == value if isinstance(value, str) else None


def org(c: str, value, listed: Iterable[str]) -> Column | None:
    """As ``one_or_many``; the word others means none of the listed ones, null included."""
    if value == "others":
        return ~F.coalesce(F.col(c).isin(list(listed)), F.lit(False))
    return one_or_many(c, value)


def any_of_array(c: str, values) -> Column:
    values = values if isinstance(values, (list, tuple)) else [values]
    return F.arrays_overlap(F.col(c), F.array(*[F.lit(v) for v in values]))


def at_least(c: str, n) -> Column:
    return F.col(c) >= F.lit(n)


def three_way(c: str, value: int) -> Column | None:
    """0: no filter, 1: equal to one, anything else: equal to zero."""
    return None if not value else F.col(c) == (1 if value == 1 else 0)


def has_assistant(owner: str, start: str, end: str, as_of, own: str = OWN_PLATFORM) -> Column:
    return (F.col(owner) == own) & (F.col(start) <= _at(as_of)) & (F.col(end) >= _at(as_of))


def process(start: str, end: str, phase: int | None, as_of) -> Column | None:
    now = _at(as_of)
    if phase == PROCESS_FUTURE:
        return F.col(start) > now
    if phase == PROCESS_RUNNING:
        return (F.col(start) <= now) & (F.col(end) >= now)
    if phase == PROCESS_ENDED:
        return F.col(end) < now
    return None


def expiration(expire: str, start: str, days: int, as_of) -> Column:
    """Not expired yet, or without an expiry and begun at most so many days ago."""
    now = _at(as_of)
    return (F.col(expire) >= now) | (F.col(expire).isNull() & (F.col(start) >= now - F.make_interval(days=F.lit(days))))


def platform_status(c: str, platform: int) -> Column | None:
    return F.col(c) >= 0 if platform == 0 else F.col(c) != -1 if platform == 1 else None


def time_status(start: str, end: str, status: int, as_of) -> Column | None:
    now = _at(as_of)
    return {-1: F.col(end) < now, 0: (F.col(end) >= now) & (F.col(start) <= now), 1: F.col(start) > now}.get(status)


#: Column of each list filter of credit courses, by its parameter.
CREDIT_LISTS = {name: name for name in ("visible", "is_enroll", "is_apply", "stage", "first_category", "second_category", "school")}


def table_driven(params: dict, columns: dict[str, str] = CREDIT_LISTS) -> list[Column]:
    """A predicate for each list parameter that is given."""
    return [F.col(columns[k]).isin(v if isinstance(v, list) else [v]) for k, v in params.items() if k in columns and v not in (None, [], "")]


def staff_name_ok(c: str) -> Column:
    x = F.col(c)
    return (F.length(x) > 1) & ~x.rlike("[#，123]")


def request_gate(c: str) -> Column:
    """What the corrector accepts: alphanumeric up to 20 characters, anything up to 8."""
    x = F.col(c)
    return (x.rlike("^[0-9A-Za-z]+$") & (F.length(x) <= 20)) | (F.length(x) <= 8)


def combine(df: DataFrame, *predicates: Column | None, exclude: Iterable[Column] = ()) -> DataFrame:
    """All predicates that are given must hold and no excluded one may; one filter, so that it reaches the scan."""
    kept = [p for p in predicates if p is not None] + [~F.coalesce(p, F.lit(False)) for p in exclude]
    for p in kept:
        df = df.where(p)
    return df


def lookup(requested: DataFrame, rows: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """The fields of each requested id, nulls where it is unknown, in the order asked for (``pos``)."""
    return requested.join(rows.select(key, *fields), key, "left").select("pos", key, *fields)


Predicate = Callable[..., Column | None]
