"""Small helpers shared by the operators."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def moment(as_of: datetime | str | Column) -> Column:
    """The reference point in time of a report."""
    return as_of if isinstance(as_of, Column) else F.lit(str(as_of)).cast("timestamp")


def before(as_of, **interval) -> Column:
    """``as_of`` minus an interval given in days, hours or seconds."""
    seconds = (
        interval.get("days", 0) * 86400
        + interval.get("hours", 0) * 3600
        + interval.get("seconds", 0)
    )
    return moment(as_of) - F.make_dt_interval(secs=F.lit(float(seconds)))


def seconds(ts: Column) -> Column:
    """Seconds since the epoch, with fraction."""
    return F.unix_micros(ts.cast("timestamp")) / F.lit(1e6)


def percent(part: Column, whole: Column, empty: float, digits: int = 2) -> Column:
    return F.when(whole > 0, F.round(part / whole * 100, digits)).otherwise(F.lit(empty))


def top_k(counted: DataFrame, k: int, by: str, *names: str, descending: bool = True) -> DataFrame:
    """First ``k`` rows by one measure; names break ties."""
    order = F.col(by).desc() if descending else F.col(by).asc()
    return counted.orderBy(order, *names).limit(k)


def frequency(df: DataFrame, column: str | Column, name: str, count: str = "count") -> DataFrame:
    """Rows per non-null value.  Counts combine before the shuffle, so a value
    that holds most of the rows costs no more than any other."""
    c = F.col(column) if isinstance(column, str) else column
    return (
        df.select(c.alias(name))
        .filter(F.col(name).isNotNull())
        .groupBy(name)
        .agg(F.count("*").alias(count))
    )


def lookup_join(facts: DataFrame, table: DataFrame, on: str, how: str = "left") -> DataFrame:
    """Equi-join of very many rows with a smaller table.

    The table is joined as it is.  Spark broadcasts it where its own size check allows that; copies of
    its rows, one for each salt, would pass that check at the size of one copy.  Where both sides are shuffled,
    adaptive execution splits the partition of a key that holds a large share of the rows (see
    ``RUNTIME_SETTINGS``).
    """
    return facts.join(table, on, how)
