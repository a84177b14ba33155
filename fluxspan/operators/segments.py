"""Segmentation of calibration flights, and assignment of rows to segments."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from fluxspan.config import PipelineConfig
from fluxspan.functions.ordered import chunk_of, flight_ends, gradient, join_flights, running_sum, slopes, with_keys, with_neighbours, wrapped
from fluxspan.schema import COL_HEADING, COL_PITCH, COL_ROLL, COL_TIME, FLIGHT, HEADINGS, MANEUVERS, ROW, SEGMENTS_DDL

STEADY_RATE = 1.0  # deg/s; fixed value
BLOCK = 1024


@dataclass(frozen=True)
class Segment:
    """One window of a recording: ``start_idx`` inclusive, ``end_idx`` exclusive."""

    maneuver: str
    heading: str
    start_idx: int
    end_idx: int


def segments_frame(spark: SparkSession, segments: Iterable[Segment], flight_id: int = 0) -> DataFrame:
    """A given list of windows of one recording, in its order."""
    return spark.createDataFrame([(flight_id, i + 1, s.maneuver, s.heading, s.start_idx, s.end_idx) for i, s in enumerate(segments)], SEGMENTS_DDL)


# -- headings ---------------------------------------------------------------
def folded_mean(headings: DataFrame, keys=(FLIGHT,), column: str = COL_HEADING) -> DataFrame:
    """Circular mean of headings folded into a quarter turn, per key."""
    angle = F.radians(F.pmod(F.col(column), F.lit(90.0)))
    mean = headings.groupBy(*keys).agg(F.avg(F.sin(angle)).alias("_s"), F.avg(F.cos(angle)).alias("_c"))
    return mean.select(*keys, F.pmod(F.degrees(F.atan2("_s", "_c")), F.lit(90.0)).alias("reference_deg"))


def resolve_reference_heading(config: PipelineConfig, headings: DataFrame, keys=(FLIGHT,)) -> DataFrame:
    """Configured reference heading, or the folded mean, per key."""
    if config.reference_heading_deg is None:
        return folded_mean(headings, keys)
    return headings.select(*keys).distinct().withColumn("reference_deg", F.lit(float(config.reference_heading_deg)))


def centre_columns(reference: Column) -> dict[str, Column]:
    """Bin centres N, E, S, W for a reference heading column: of the four
    perpendicular directions the one nearest to north, then clockwise."""
    spokes = [F.pmod(reference + F.lit(90.0 * k), F.lit(360.0)) for k in range(4)]
    north = [F.least(s, F.lit(360.0) - s) for s in spokes]
    nearest = F.lit(3)
    for k in (2, 1, 0):
        others = [north[k] <= north[j] if k < j else north[k] < north[j] for j in range(4) if j != k]
        nearest = F.when(others[0] & others[1] & others[2], k).otherwise(nearest)
    pick = lambda q: F.element_at(F.array(*spokes), (nearest + q) % 4 + 1)
    return {h: pick(q) for q, h in enumerate(HEADINGS)}


def bin_centres_from_ref(reference: float) -> dict[str, float]:
    """The same for one number."""
    spokes = [(reference + 90.0 * k) % 360.0 for k in range(4)]
    first = min(range(4), key=lambda k: (min(spokes[k], 360.0 - spokes[k]), k))
    return {h: spokes[(first + q) % 4] for q, h in enumerate(HEADINGS)}


def assign_heading_bin(heading: Column, centres: dict[str, Column], tolerance: float) -> Column:
    """Nearest centre within the tolerance (inclusive); the earlier one of N, E,
    S, W wins a tie; null for NaN, null and headings beyond the tolerance."""
    away = {h: F.abs(F.pmod(heading - c + 180.0, F.lit(360.0)) - 180.0) for h, c in centres.items()}
    nearest = F.least(*away.values()) if len(away) > 1 else next(iter(away.values()))
    choice = F.lit(None).cast("string")
    for h in reversed([h for h in HEADINGS if h in away]):
        choice = F.when(away[h] == nearest, h).otherwise(choice)
    return F.when(heading.isNotNull() & ~F.isnan(heading) & (nearest <= tolerance), choice)


# -- maneuvers --------------------------------------------------------------
def classify_maneuver(pitch: Column, roll: Column, yaw: Column) -> Column:
    """Steady below the rate threshold, else the axis with the largest rate;
    pitch before roll before yaw on ties.  Null if a rate is null or NaN."""
    p, r, y = F.abs(pitch), F.abs(roll), F.abs(yaw)
    bad = p.isNull() | r.isNull() | y.isNull() | F.isnan(p) | F.isnan(r) | F.isnan(y)
    axis = F.when((p >= r) & (p >= y), "pitch").when((r >= p) & (r >= y), "roll").otherwise("yaw")
    return F.when(~bad, F.when(F.greatest(p, r, y) < STEADY_RATE, "steady").otherwise(axis))


def unwrapped_heading(df: DataFrame) -> DataFrame:
    """Adds ``heading_unwrapped`` (radians): jumps beyond half a turn removed."""
    turned = F.radians(F.col(COL_HEADING))

    def steps(x, w):
        step = turned - F.lag(turned).over(w)
        return x.withColumn("_fix", F.coalesce(wrapped(step) - step, F.lit(0.0)))

    fixed = running_sum(with_neighbours(df, [FLIGHT], 1, 0, steps), [FLIGHT], "_fix", "_turns")
    return fixed.withColumn("heading_unwrapped", turned + F.col("_turns")).drop("_fix", "_turns")


def _with_bins(df: DataFrame, config: PipelineConfig) -> DataFrame:
    if config.reference_heading_deg is not None:
        centred, reference = df, F.lit(float(config.reference_heading_deg))
    else:
        centred, reference = join_flights(df, folded_mean(df).join(flight_ends(df), FLIGHT)), F.col("reference_deg")
    return centred.withColumn("bin", assign_heading_bin(F.col(COL_HEADING), centre_columns(reference), config.heading_tolerance_deg))


def attitude_rates(df: DataFrame, config: PipelineConfig) -> DataFrame:
    """Rows with heading bin, pitch, roll and yaw rates (deg/s) and maneuver.

    The yaw rate comes from steps of the unwrapped heading, which are local, so
    no running total is needed; it is zero on the first row of a new bin.
    """
    turned = F.radians(F.col(COL_HEADING))

    def rates(x, w):
        time, before, after = F.col(COL_TIME), F.lag(COL_TIME).over(w), F.lead(COL_TIME).over(w)
        yaw = F.degrees(slopes(wrapped(turned - F.lag(turned).over(w)), wrapped(F.lead(turned).over(w) - turned), time - before, after - time))
        moved = before.isNotNull() & ~F.col("bin").eqNullSafe(F.lag("bin").over(w))
        return x.withColumns(
            {"pitch_deg_s": gradient(F.col(COL_PITCH), time, w), "roll_deg_s": gradient(F.col(COL_ROLL), time, w), "yaw_deg_s": F.when(moved, F.lit(0.0)).otherwise(yaw)}
        )

    out = with_neighbours(_with_bins(df, config), [FLIGHT], 1, 1, rates)
    return out.withColumn("maneuver", classify_maneuver(F.col("pitch_deg_s"), F.col("roll_deg_s"), F.col("yaw_deg_s")))


# -- segments ---------------------------------------------------------------
def islands(df: DataFrame, label: list[str]) -> DataFrame:
    """Runs of equal labels (null is a value): flight_id, run, the labels,
    start_idx, end_idx (exclusive).

    Only the rows at which a label changes, and the last one of each flight, go
    on from the first window; a run ends where the next one begins.  Runs of a
    chunk get their number and their last end from one row per chunk.
    """

    def mark(x, w):
        same = F.lit(True)
        for c in label:
            same = same & F.col(c).eqNullSafe(F.lag(c).over(w))
        return x.withColumns({"_new": F.lag(ROW).over(w).isNull() | ~same, "_last": F.lead(ROW).over(w).isNull()})

    marked = with_neighbours(df.select(FLIGHT, ROW, *label), [FLIGHT], 1, 1, mark)
    edges = marked.where("_new or _last").withColumn("_part", chunk_of(F.col(ROW)))
    parts = edges.groupBy(FLIGHT, "_part").agg(F.count_if("_new").alias("_n"), F.min(F.when(F.col("_new"), F.col(ROW))).alias("_first"), F.max(F.when(F.col("_last"), F.col(ROW) + 1)).alias("_end"))
    in_order = W.Window.partitionBy(FLIGHT).orderBy("_part")
    links = parts.select(
        FLIGHT,
        "_part",
        F.coalesce(F.sum("_n").over(in_order.rowsBetween(W.Window.unboundedPreceding, -1)), F.lit(0)).alias("_ahead"),
        F.coalesce(F.first("_first", ignorenulls=True).over(in_order.rowsBetween(1, W.Window.unboundedFollowing)), F.max("_end").over(W.Window.partitionBy(FLIGHT))).alias("_beyond"),
    )
    within = W.Window.partitionBy(FLIGHT, "_part").orderBy(ROW)
    starts = edges.where("_new").select(FLIGHT, "_part", ROW, *label, F.row_number().over(within).alias("_rank"), F.lead(ROW).over(within).alias("_next"))
    return starts.join(links, [FLIGHT, "_part"]).select(
        FLIGHT, (F.col("_ahead") + F.col("_rank")).alias("run"), *label, F.col(ROW).cast("int").alias("start_idx"), F.coalesce("_next", "_beyond").cast("int").alias("end_idx")
    )


def _ordered(runs: DataFrame) -> DataFrame:
    return runs.select(FLIGHT, F.col("run").cast("int").alias("seg_ord"), "maneuver", "heading", "start_idx", "end_idx")


def explicit_segments(df: DataFrame, label_col: str) -> DataFrame:
    """Segments of a label column '<maneuver>_<heading>'; any other label is an
    error that surfaces when the result is computed."""
    if label_col not in df.columns:
        raise ValueError(f"segment label column {label_col!r} is missing")
    runs = islands(with_keys(df).withColumn("_label", F.col(label_col).cast("string")), ["_label"])
    parts = F.split("_label", "_")
    good = F.coalesce((F.size(parts) == 2) & parts[0].isin(*MANEUVERS) & parts[1].isin(*HEADINGS), F.lit(False))
    bad = F.raise_error(F.concat(F.lit("invalid segment label: "), F.coalesce("_label", F.lit("None")))).cast("string")
    checked = runs.withColumn("maneuver", F.when(good, parts[0]).otherwise(bad)).withColumn("heading", parts[1])
    return _ordered(checked)


def auto_segments(df: DataFrame, config: PipelineConfig) -> DataFrame:
    """Segments found from heading, pitch and roll; rows whose heading is beyond
    the tolerance split segments and belong to none."""
    missing = [c for c in (COL_HEADING, COL_PITCH, COL_ROLL, COL_TIME) if c not in df.columns]
    if missing:
        raise ValueError(f"automatic segmentation needs the columns {missing}")
    rated = attitude_rates(with_keys(df), config).select(FLIGHT, ROW, "maneuver", F.col("bin").alias("heading"))
    return _ordered(islands(rated, ["maneuver", "heading"]).where("heading is not null and maneuver is not null"))


def segment_fom(df: DataFrame, config: PipelineConfig) -> DataFrame:
    """flight_id, seg_ord, maneuver, heading, start_idx, end_idx."""
    return explicit_segments(df, config.segment_label_col) if config.segment_label_col else auto_segments(df, config)


def check_segments(df: DataFrame, segments: DataFrame, least: int = 1) -> None:
    """Segments must exist, lie within their flights and hold ``least`` rows."""
    joined = segments.join(flight_ends(with_keys(df)), FLIGHT, "left")
    wrong = F.col("_last").isNull() | (F.col("start_idx") < 0) | (F.col("end_idx") <= F.col("start_idx")) | (F.col("end_idx") > F.col("_last") + 1)
    n, bad, short = joined.agg(F.count("*"), F.count_if(wrong), F.count_if(F.col("end_idx") - F.col("start_idx") < least)).first()
    if not n:
        raise ValueError("segments must be non-empty")
    if bad:
        raise ValueError(f"{bad} segments have bounds outside their flight")
    if short:
        raise ValueError(f"At least {least} rows are needed per segment for model terms c and d")


def touched_blocks(segments: DataFrame, rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """``segments`` once per block of positions they touch (``_block``).  Bounds
    are first cut to the rows there are, so an absurd one can't list more blocks
    than its flight has."""
    cut = segments.join(flight_ends(rows), FLIGHT)
    low, high = F.greatest("start_idx", F.lit(0)), F.least(F.col("end_idx"), F.col("_last") + 1)
    listed = F.explode(F.sequence(F.floor(low / block), F.floor((high - 1) / block)))
    return cut.where(low < high).withColumn("_block", listed).drop("_last")


def rows_in_segments(df: DataFrame, segments: DataFrame) -> DataFrame:
    """Rows of every segment, once per segment that covers them.

    An equi-join on (flight_id, block of positions): each segment is listed in
    the blocks it touches, so no flight is compared as a whole.
    """
    keyed = with_keys(df)
    slim = segments.select(FLIGHT, "seg_ord", F.col("maneuver").alias("seg_maneuver"), F.col("heading").alias("seg_heading"), "start_idx", "end_idx")
    rows = keyed.withColumn("_block", F.floor(F.col(ROW) / BLOCK))
    return rows.join(touched_blocks(slim, keyed), [FLIGHT, "_block"]).where(f"{ROW} >= start_idx and {ROW} < end_idx").drop("_block")


def steady_rows(df: DataFrame, segments: DataFrame) -> DataFrame:
    """All rows with ``steady``: whether a steady segment covers them.

    Each block of positions carries the spans of the steady segments that touch
    it, so the rows take part in one join and are neither repeated nor regrouped.
    """
    keyed = with_keys(df)
    steady = segments.where("maneuver = 'steady' and end_idx > start_idx").select(FLIGHT, "start_idx", "end_idx")
    spans = touched_blocks(steady, keyed).groupBy(FLIGHT, "_block").agg(F.collect_set(F.struct("start_idx", "end_idx")).alias("_spans"))
    rows = keyed.withColumn("_block", F.floor(F.col(ROW) / BLOCK)).join(spans, [FLIGHT, "_block"], "left")
    covered = F.exists("_spans", lambda s: (F.col(ROW) >= s["start_idx"]) & (F.col(ROW) < s["end_idx"]))
    return rows.withColumn("steady", F.coalesce(covered, F.lit(False))).drop("_block", "_spans")
