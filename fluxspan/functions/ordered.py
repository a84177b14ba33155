"""Order-dependent building blocks that don't need a whole flight in one task.

Rows of a flight are addressed by contiguous positions ``row_idx``.  Windows run
over chunks of positions; a few rows beyond either border are copied into the
chunk where an operator looks at neighbours, and running totals get the sum of
the earlier chunks from a table with one row per chunk.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from fluxspan.schema import FLIGHT, ROW

CHUNK = 65_536


def numbered(df: DataFrame, out: str) -> DataFrame:
    """Numbers rows from 0 in the order in which they are read.

    Every partition counts its own rows; what the partitions ahead of it hold is
    added from a table with one row per partition, so no task sees all rows.
    The input must be read the same way twice, as files are.
    """
    placed = df.withColumn("_read", F.monotonically_increasing_id())
    part, local = F.shiftright("_read", 33), F.col("_read").bitwiseAND((1 << 33) - 1)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_size"))
    ahead = F.sum("_size").over(W.Window.orderBy("_part").rowsBetween(W.Window.unboundedPreceding, -1))
    offsets = sizes.select("_part", F.coalesce(ahead, F.lit(0)).alias("_ahead"))
    return placed.withColumn("_part", part).join(offsets, "_part").withColumn(out, (F.col("_ahead") + local).cast("int")).drop("_read", "_part", "_ahead")


def with_keys(df: DataFrame) -> DataFrame:
    """Give a single recording its keys.

    A missing ``flight_id`` becomes 0.  A missing ``row_idx`` is numbered in the
    order in which the rows are read, within all rows if ``flight_id`` is missing
    too, else within each flight.
    """
    lone = FLIGHT not in df.columns
    if lone:
        df = df.withColumn(FLIGHT, F.lit(0))
    if ROW in df.columns:
        return df
    if lone:
        return numbered(df, ROW)
    placed = numbered(df, "_at")
    # rows of one flight that are read together are numbered together
    chunked = placed.withColumn("_block", F.floor(F.col("_at") / CHUNK))
    ranked = chunked.withColumn("_rank", F.row_number().over(W.Window.partitionBy(FLIGHT, "_block").orderBy("_at")) - 1)
    counts = chunked.groupBy(FLIGHT, "_block").agg(F.count("*").alias("_size"))
    earlier = W.Window.partitionBy(FLIGHT).orderBy("_block").rowsBetween(W.Window.unboundedPreceding, -1)
    offsets = counts.select(FLIGHT, "_block", F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_ahead"))
    return ranked.join(offsets, [FLIGHT, "_block"]).withColumn(ROW, (F.col("_ahead") + F.col("_rank")).cast("int")).drop("_at", "_block", "_rank", "_size", "_ahead")


def chunk_of(position: Column, size: int = CHUNK) -> Column:
    return F.floor(position / F.lit(size)).cast("int")


def with_neighbours(df: DataFrame, keys: Sequence[str], before: int, after: int, build, size: int = CHUNK) -> DataFrame:
    """Apply ``build(df, window)`` where the window sees ``before`` rows ahead of
    and ``after`` rows behind every row of the same ``keys``."""
    own, offset = chunk_of(F.col(ROW), size), F.col(ROW) % size
    places = [own]
    if before:
        places.append(F.when(offset >= size - before, own + 1))
    if after:
        places.append(F.when(offset < after, own - 1))
    spread = df.withColumn("_chunk", F.explode(F.array_compact(F.array(*places))))
    window = W.Window.partitionBy(*keys, "_chunk").orderBy(ROW)
    return build(spread, window).where(chunk_of(F.col(ROW), size) == F.col("_chunk")).drop("_chunk")


def running_sum(df: DataFrame, keys: Sequence[str], value: str, out: str, size: int = CHUNK) -> DataFrame:
    """``out`` = sum of ``value`` over all earlier rows of ``keys`` and this one."""
    chunked = df.withColumn("_chunk", chunk_of(F.col(ROW), size))
    totals = chunked.groupBy(*keys, "_chunk").agg(F.sum(value).alias("_total"))
    earlier = W.Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(W.Window.unboundedPreceding, -1)
    offsets = totals.select(*keys, "_chunk", F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_offset"))
    within = W.Window.partitionBy(*keys, "_chunk").orderBy(ROW).rowsBetween(W.Window.unboundedPreceding, 0)
    summed = chunked.withColumn("_within", F.sum(value).over(within))
    return summed.join(offsets, [*keys, "_chunk"]).withColumn(out, F.col("_within") + F.col("_offset")).drop("_chunk", "_within", "_offset")


def flight_ends(df: DataFrame) -> DataFrame:
    """flight_id and ``_last``, the last position of each flight."""
    return df.groupBy(FLIGHT).agg(F.max(ROW).alias("_last"))


def join_flights(rows: DataFrame, table: DataFrame, how: str = "inner") -> DataFrame:
    """Rows with the columns of a table that has one row per flight and, in
    ``_last``, the flight's last position.  The table is listed once per chunk of
    positions, so the rows of a long flight don't meet in one task."""
    listed = table.withColumn("_chunk", F.explode(F.sequence(F.lit(0), chunk_of(F.col("_last"))))).drop("_last")
    return rows.withColumn("_chunk", chunk_of(F.col(ROW))).join(listed, [FLIGHT, "_chunk"], how).drop("_chunk")


def gradient(value: Column, time: Column, window: W.WindowSpec) -> Column:
    """Second-order derivative on uneven times; one-sided at either end."""
    back, ahead = F.lag(value).over(window), F.lead(value).over(window)
    return slopes(value - back, ahead - value, time - F.lag(time).over(window), F.lead(time).over(window) - time)


def slopes(fall: Column, rise: Column, hs: Column, hd: Column) -> Column:
    """Derivative from the steps to the previous (``fall`` over ``hs``) and to the
    next row (``rise`` over ``hd``); a missing side leaves the other one."""
    both = F.try_divide(hs * F.try_divide(rise, hd) + hd * F.try_divide(fall, hs), hs + hd)
    return F.when(hs.isNull(), F.try_divide(rise, hd)).when(hd.isNull(), F.try_divide(fall, hs)).otherwise(both)


def backward_difference(value: Column, time: Column, window: W.WindowSpec) -> Column:
    """Causal derivative; the first row repeats the second one's."""
    past = F.try_divide(value - F.lag(value).over(window), time - F.lag(time).over(window))
    next_ = F.try_divide(F.lead(value).over(window) - value, F.lead(time).over(window) - time)
    return F.when(F.lag(time).over(window).isNull(), next_).otherwise(past)


def wrapped(step: Column) -> Column:
    """A step of an angle in radians brought into [-pi, pi], keeping the sign of
    a half turn."""
    pi = F.lit(3.141592653589793)
    inside = F.pmod(step + pi, 2 * pi) - pi
    inside = F.when((inside == -pi) & (step > 0), pi).otherwise(inside)
    return F.when(F.abs(step) < pi, step).otherwise(inside)
