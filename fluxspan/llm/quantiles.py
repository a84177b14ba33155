"""Percentiles of very large columns from mergeable logarithmic buckets.

A value x falls into the signed bucket ceil(log(|x|) / log(g)) with
g = (1 + a) / (1 - a); any value in a bucket differs from the bucket's
representative 2 g^i / (g + 1) by at most the share ``a``.  Sketches are plain
tables of bucket counts, so they merge by adding counts: over partitions,
flights or days, in any order, without loss.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from fluxspan.llm.labels import heading_name, maneuver_name

ERROR = 0.01  # guaranteed relative error of every percentile
PERCENTS = (1, 5, 25, 50, 75, 95, 99)
BLOCK = 512


def bucket_of(x, error: float = ERROR):
    """Signed bucket number; 0 holds exact zeros, positive values have numbers
    shifted beyond every possible exponent, negative ones mirror them."""
    log_g = math.log((1 + error) / (1 - error))
    shift = math.ceil(760 / log_g)  # |log| of any double is below 746
    size = F.ceil(F.log(F.abs(x)) / F.lit(log_g)).cast("int") + F.lit(shift)
    return F.when(x > 0, size).when(x < 0, -size).otherwise(F.lit(0))


def value_of(bucket, error: float = ERROR):
    """Representative value of a bucket."""
    g = (1 + error) / (1 - error)
    shift = math.ceil(760 / math.log(g))
    # from the bucket's lower border, which no value's size can overflow
    size = F.lit(2 * g / (g + 1)) * F.pow(F.lit(g), F.abs(bucket) - F.lit(shift + 1))
    return F.when(bucket == 0, F.lit(0.0)).otherwise(F.signum(bucket.cast("double")) * size)


def sketch(df: DataFrame, keys: list[str], column: str, error: float = ERROR) -> DataFrame:
    """Bucket counts per group: keys, bucket, n.  Null, NaN and infinite values
    are left out.  Partial counts are added before the shuffle, so what moves is
    bounded by groups x buckets per task."""
    x = F.col(column)
    finite = x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return df.where(finite).groupBy(*keys, bucket_of(x, error).alias("bucket")).agg(F.count("*").alias("n"))


def merge(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """Sketches of coarser groups (or of several unioned tables)."""
    return sketches.groupBy(*keys, "bucket").agg(F.sum("n").alias("n"))


def percentiles(sketches: DataFrame, keys: list[str], percents=PERCENTS, error: float = ERROR) -> DataFrame:
    """keys, n, then one column pNN per percentile: the representative of the
    bucket that holds the value of rank ceil(NN/100 n).  The window runs over the
    buckets of a group, whose number the exponent range bounds."""
    order = W.Window.partitionBy(*keys).orderBy("bucket").rowsBetween(W.Window.unboundedPreceding, 0)
    total = W.Window.partitionBy(*keys)
    ranked = sketches.withColumn("upto", F.sum("n").over(order)).withColumn("total", F.sum("n").over(total))
    picks = [F.min(F.when(F.col("upto") * 100 >= F.col("total") * p, F.col("bucket"))).alias(f"b{p}") for p in percents]
    picked = ranked.groupBy(*keys).agg(F.max("total").cast("bigint").alias("n"), *picks)
    return picked.select(*keys, "n", *[value_of(F.col(f"b{p}"), error).alias(f"p{p:02d}") for p in percents])


def merged_intervals(segments: DataFrame, rows: DataFrame) -> DataFrame:
    """Disjoint row intervals per (flight, maneuver, heading), cut into blocks:
    flight_id, block, maneuver, heading, lo, hi.

    Each record is first cut to the rows its flight has, then at block borders;
    overlaps are merged within a block, so no task has to hold a flight's records.
    """
    known = (
        segments.where("flight_id is not null and start_idx is not null and end_idx is not null and end_idx > start_idx")
        .select("flight_id", "start_idx", "end_idx", maneuver_name(F.col("maneuver")).alias("maneuver"), heading_name(F.col("heading")).alias("heading"))
        .where("maneuver is not null and heading is not null")
    )
    span = rows.where("flight_id is not null and row_idx is not null").groupBy("flight_id").agg(F.min("row_idx").alias("_first"), F.max("row_idx").alias("_last"))
    cut = known.join(span, "flight_id").select("flight_id", "maneuver", "heading", F.greatest("start_idx", "_first").alias("start_idx"), F.least("end_idx", F.col("_last") + 1).alias("end_idx")).where("end_idx > start_idx")
    start, end = F.col("start_idx"), F.col("end_idx")
    pieces = cut.withColumn("block", F.explode(F.sequence(F.floor(start / BLOCK), F.floor((end - 1) / BLOCK)))).select(
        "flight_id", "block", "maneuver", "heading", F.greatest(start, F.col("block") * BLOCK).alias("lo"), F.least(end, (F.col("block") + 1) * BLOCK).alias("hi")
    )
    group = ["flight_id", "block", "maneuver", "heading"]
    order = W.Window.partitionBy(*group).orderBy("lo", "hi")
    reach = F.max("hi").over(order.rowsBetween(W.Window.unboundedPreceding, -1))
    islands = pieces.withColumn("fresh", F.when(reach.isNull() | (F.col("lo") > reach), 1).otherwise(0)).withColumn("island", F.sum("fresh").over(order))
    return islands.groupBy(*group, "island").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).drop("island")


def labelled_values(rows: DataFrame, segments: DataFrame, column: str = "delta_b") -> DataFrame:
    """flight_id, row_idx, maneuver, heading and the value, each (flight_id,
    row_idx) once per pair.  One exchange of the rows, on (flight_id, block),
    serves the deduplication and the join; long flights spread by block."""
    once = (
        rows.where("flight_id is not null and row_idx is not null")
        .select("flight_id", "row_idx", F.col(column).cast("double").alias(column), F.floor(F.col("row_idx") / BLOCK).alias("block"))
        .repartition("flight_id", "block")
        .dropDuplicates(["flight_id", "block", "row_idx"])
    )
    return once.join(merged_intervals(segments, rows), ["flight_id", "block"]).where("row_idx >= lo and row_idx < hi").select("flight_id", "row_idx", "maneuver", "heading", column)


def segment_percentiles(rows: DataFrame, segments: DataFrame, column: str = "delta_b") -> DataFrame:
    """Percentiles per (maneuver, heading) over all rows its records cover.

    Defined results: records of unknown maneuver or heading, or with impossible
    bounds, cover nothing; rows delivered twice count once; null, NaN and
    infinite values are left out; a pair without values has no row.
    """
    keys = ["maneuver", "heading"]
    return percentiles(sketch(labelled_values(rows, segments, column), keys, column), keys)


def daily_sketches(rows: DataFrame, segments: DataFrame, flights: DataFrame, column: str = "delta_b") -> DataFrame:
    """Sketches per flown_on day and (maneuver, heading), added up from those of
    single flights; they can be stored and merged into any longer period.  Values
    of flights without a row in ``flights`` are kept under a null day."""
    per_flight = sketch(labelled_values(rows, segments, column), ["flight_id", "maneuver", "heading"], column)
    days = flights.select("flight_id", "flown_on").where("flight_id is not null").dropDuplicates(["flight_id"])
    return merge(per_flight.join(days, "flight_id", "left"), ["flown_on", "maneuver", "heading"])
