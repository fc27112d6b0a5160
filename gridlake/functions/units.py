"""Date and time units stored as whole numbers since 1970, to and from Spark's types.  Column expressions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Units of a microsecond or longer, in microseconds.
MICROS = {"US": 1, "MS": 10**3, "SEC": 10**6, "MIN": 60 * 10**6, "HR": 3600 * 10**6, "DAY": 86_400 * 10**6, "WEEK": 7 * 86_400 * 10**6}
#: Shorter units: how many make a microsecond.
PARTS = {"NS": 10**3, "PS": 10**6, "FS": 10**9, "AS": 10**12}
#: A twelfth of 365 days, in seconds: the month of the compatible conversion.
MONTH_SECONDS = 2_628_000
UNITS = ("YEAR", "MONTH", *MICROS, *PARTS)


def _ntz(micros: Column) -> Column:
    """Microseconds since 1970 as a timestamp without zone, whatever the session's zone is."""
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + micros.cast("bigint") * F.expr("INTERVAL '0.000001' SECOND")


def to_micros(value: Column, unit: str) -> Column:
    """A count of units as microseconds (finer units lose what is below one)."""
    value = value.cast("bigint")
    if unit in MICROS:
        return value * F.lit(MICROS[unit])
    if unit in PARTS:
        return trunc_div(value, PARTS[unit])
    raise ValueError(f"no fixed length: {unit}")


def trunc_div(value: Column, by: int) -> Column:
    """Whole division towards zero."""
    return F.call_function("div", value.cast("bigint"), F.lit(by).cast("bigint"))


def from_unit(value: Column, unit: str, compat_month: bool = False) -> Column:
    """A count of units since 1970 as YEAR (int), DATE (year to day) or TIMESTAMP (shorter).

    Months follow the calendar; with ``compat_month`` each is a twelfth of 365 days and the result a timestamp.
    """
    if unit == "YEAR":
        return (value + F.lit(1970)).cast("int")
    if unit == "MONTH":
        return _ntz(value.cast("bigint") * F.lit(MONTH_SECONDS * 10**6)) if compat_month else F.add_months(F.lit("1970-01-01").cast("date"), value.cast("int"))
    if unit in ("WEEK", "DAY"):
        return F.date_add(F.lit("1970-01-01").cast("date"), (value * F.lit(7 if unit == "WEEK" else 1)).cast("int"))
    return _ntz(to_micros(value, unit))


def micros_of(ts: Column) -> Column:
    """Microseconds since 1970 of a DATE or TIMESTAMP without zone."""
    span = ts.cast("timestamp_ntz") - F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    days, rest = F.extract(F.lit("DAY"), span), F.extract(F.lit("SECOND"), span)
    hours, minutes = F.extract(F.lit("HOUR"), span), F.extract(F.lit("MINUTE"), span)
    return days.cast("bigint") * F.lit(86_400_000_000) + (hours * 3600 + minutes * 60).cast("bigint") * F.lit(1_000_000) + (rest * 1_000_000).cast("bigint")


def to_unit(ts: Column, unit: str) -> Column:
    """A DATE or TIMESTAMP as whole units since 1970, rounded towards minus infinity; finer units are exact multiples."""
    if unit == "YEAR":
        return (F.year(ts) - 1970).cast("bigint")
    if unit == "MONTH":
        return ((F.year(ts) - 1970) * 12 + F.month(ts) - 1).cast("bigint")
    micros = micros_of(ts)
    if unit in PARTS:
        return micros * F.lit(PARTS[unit])
    size = MICROS[unit]
    return trunc_div(micros - F.pmod(micros, F.lit(size)), size)


def time_from_unit(value: Column, unit: str) -> Column:
    """A signed count of time units as a day-time interval."""
    return to_micros(value, unit) * F.expr("INTERVAL '0.000001' SECOND")


def time_parts(micros: Column) -> dict[str, Column]:
    """Sign and whole parts of a time in microseconds."""
    size = F.abs(micros)
    return {
        "sign": F.when(micros < 0, F.lit(-1)).otherwise(F.lit(1)),
        "hour": trunc_div(size, 3_600_000_000),
        "minute": F.pmod(trunc_div(size, 60_000_000), F.lit(60)),
        "second": F.pmod(trunc_div(size, 1_000_000), F.lit(60)),
        "micro": F.pmod(size, F.lit(1_000_000)),
    }


def time_to_micros(sign: Column, hour: Column, minute: Column, second: Column, micro: Column) -> Column:
    return sign * (((hour * 60 + minute) * 60 + second).cast("bigint") * F.lit(1_000_000) + micro)
