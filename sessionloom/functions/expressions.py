"""Column expressions shared by the operators; all of them stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionloom.constants import EVENT_TYPES, SECONDS_PER_DAY


def epoch_seconds(ts: str) -> Column:
    """Whole seconds since the epoch of a zone-less timestamp, whatever the session time zone."""
    day = F.unix_date(F.to_date(ts)).cast("long")
    return (day * SECONDS_PER_DAY + F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)).cast("long")


def weekday(ts: str = "ts") -> Column:
    """Monday = 0, from epoch seconds (the epoch was a Thursday)."""
    return F.expr(f"cast(pmod({ts} div 86400 + 3, 7) as int)")


def hour_of_day(ts: str = "ts") -> Column:
    return F.expr(f"cast(pmod({ts}, 86400) div 3600 as int)")


def minute_of_hour(ts: str = "ts") -> Column:
    return F.expr(f"cast(pmod({ts}, 3600) div 60 as int)")


def day_of_month(ts: str = "ts") -> Column:
    return F.expr(f"dayofmonth(date_from_unix_date(cast({ts} div 86400 as int)))")


def divide(a: Column, b: Column) -> Column:
    """a / b with 0 where the quotient is undefined."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def count_where(condition: Column) -> Column:
    """Rows matching a condition, as a sum so that it also works over windows."""
    return F.sum(condition.cast("long"))


def type_is(event: str) -> Column:
    return F.col("type") == EVENT_TYPES[event]


def spread(key: Column, seed: int = 0) -> Column:
    """Arithmetic hash of an integer into [0, 2^31 - 1), the same in every SQL engine."""
    first = F.pmod(F.pmod(key.cast("long"), F.lit(2147483647)) * 48271 + (11 + seed * 7919), F.lit(2147483647))
    return F.pmod(first * 69621 + 7, F.lit(2147483647))


def rank_weight(rank: Column, candidates: int) -> Column:
    """Weight of a candidate by its rank from 1: falls from 1 to sqrt(2) - 1."""
    step = 0.5 / (candidates - 1) if candidates > 1 else 0.0
    return F.pow(F.lit(2.0), F.lit(1.0) - (rank - 1) * F.lit(step)) - 1.0


def bounds(events: DataFrame) -> Column:
    """One struct (lo, hi) of the frame's time stamps, as a scalar subquery: no join."""
    return events.agg(F.struct(F.min("ts").alias("lo"), F.max("ts").alias("hi")).alias("b")).scalar()


def span_days(limits: Column) -> Column:
    return (limits["hi"] - limits["lo"]) / float(SECONDS_PER_DAY)


# Exact sample deviation of an integer column through partial sums -----------
# x*x is carried as quotient and remainder of 10^6, so that sums of very many
# rows stay inside a long and merge to the same result in any order.


def square_sums(x: str, name: str) -> list[Column]:
    return [
        F.expr(f"sum(({x} * {x}) div 1000000)").alias(f"{name}_sqh"),
        F.expr(f"sum(({x} * {x}) % 1000000)").alias(f"{name}_sql"),
    ]


def merged_square_sums(name: str) -> list[Column]:
    return [F.sum(f"{name}_sqh").alias(f"{name}_sqh"), F.sum(f"{name}_sql").alias(f"{name}_sql")]


def deviation(n: Column, total: Column, name: str) -> Column:
    """Sample standard deviation from count, sum and the parts of square_sums; null for one row."""
    squares = F.col(f"{name}_sqh").cast("decimal(19,0)") * F.lit(1000000) + F.col(f"{name}_sql")
    top = n.cast("decimal(13,0)") * squares.cast("decimal(25,0)") - (
        total.cast("decimal(19,0)") * total.cast("decimal(19,0)")
    )
    below = n.cast("double") * (n.cast("double") - 1.0)
    return F.when(n > 1, F.sqrt(top.cast("double") / below))
