"""Reading times written as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_MS = 86_400_000
WEEK_MS = 7 * DAY_MS
#: 1970-01-05 was a Monday.
MONDAY_MS = 4 * DAY_MS

EPOCH = r"^[+-]?[0-9]{1,18}$"
DATE = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"
ZONED = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}:[0-9]{2}(:[0-9]{2}([.][0-9]{1,9})?)?(Z|[+-][0-9]{2}:?[0-9]{2})$"
PLAIN = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}:[0-9]{2}(:[0-9]{2}([.][0-9]{1,9})?)?$"


def text_millis(col: Column | str) -> Column:
    """Epoch ms of a text: epoch ms itself, a date (its first instant), a date-time with ``Z``,
    with an offset, or with none (UTC).  Null for anything that can't be read."""
    t = F.upper(F.trim(F.col(col) if isinstance(col, str) else col))
    at = lambda c: F.unix_millis(c.try_cast("timestamp"))
    return (
        F.when(t.rlike(EPOCH), t.try_cast("long"))
        .when(t.rlike(DATE), at(F.concat(t, F.lit("T00:00:00Z"))))
        .when(t.rlike(ZONED), at(F.regexp_replace(t, r"([+-][0-9]{2})([0-9]{2})$", "$1:$2")))
        .when(t.rlike(PLAIN), at(F.concat(t, F.lit("Z"))))
    )


def week_start_ms(ms: Column) -> Column:
    """First instant (Monday 00:00 UTC) of the week of an instant."""
    return ms - F.pmod(ms - F.lit(MONDAY_MS), F.lit(WEEK_MS))
