"""Runs of consecutive records that mean the same, collapsed into one.

Method: boundary interval lookup.  Records are ordered within chunks of each
flight; the positions at which a run starts are gathered into one sorted array
per chunk, every record finds its run by binary search in it, and runs are
aggregated.  What a chunk can't know by itself - whether its first record
continues a run of earlier chunks - comes from one small summary row per chunk,
so a flight with any number of records never has to fit into one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from fluxspan.llm.labels import heading_name, maneuver_name
from fluxspan.shared import checkpointed

CHUNK = 65_536  # flight rows by which records are put into chunks
MAX_GAP = 50
BLOCK = 512

_COLUMNS = ("flight_id", "run_chunk", "run_no", "maneuver", "heading", "start_idx", "end_idx", "n_records")
_PARTS = "flight_id bigint, run_chunk bigint, run_no int, maneuver string, heading string, start_idx bigint, end_idx bigint, n_records bigint"


def usable_records(segments: DataFrame) -> DataFrame:
    """Distinct records with possible bounds, their meaning and their chunk."""
    return (
        segments.select("flight_id", "maneuver", "heading", "start_idx", "end_idx")
        .where("flight_id is not null and start_idx is not null and end_idx is not null and end_idx > start_idx")
        .withColumn("chunk", F.floor(F.col("start_idx") / CHUNK).cast("bigint"))
        .repartition("flight_id", "chunk")
        .dropDuplicates(["flight_id", "chunk", "maneuver", "heading", "start_idx", "end_idx"])
        .select(
            "flight_id",
            "chunk",
            "start_idx",
            "end_idx",
            maneuver_name(F.col("maneuver")).alias("m"),
            heading_name(F.col("heading")).alias("h"),
            F.coalesce("maneuver", F.lit("")).alias("tie_m"),
            F.coalesce("heading", F.lit("")).alias("tie_h"),
        )
        .withColumn("label", F.when(F.col("m").isNotNull() & F.col("h").isNotNull(), F.concat_ws("_", "m", "h")).otherwise(F.lit("")))
    )


def chunk_carries(records: DataFrame) -> DataFrame:
    """What each chunk must know of the chunks before it: the label of the last
    record (``c_label``) and the largest end of the unbroken stretch of that
    label (``c_end``), and the chunk in which that stretch began."""
    in_chunk = W.Window.partitionBy("flight_id", "chunk").orderBy("start_idx", "end_idx", "m", "h", "tie_m", "tie_h")
    fresh = F.when(F.col("label") == F.lag("label").over(in_chunk), 0).otherwise(1)
    stretches = (
        records.withColumn("fresh", fresh)
        .withColumn("stretch", F.sum("fresh").over(in_chunk))
        .groupBy("flight_id", "chunk", "stretch")
        .agg(F.first("label").alias("label"), F.max("end_idx").alias("end"))
    )
    tail = stretches.groupBy("flight_id", "chunk").agg(F.max_by("label", "stretch").alias("last"), F.max_by("end", "stretch").alias("tail_end"), F.max("stretch").alias("stretches"))
    by_chunk = W.Window.partitionBy("flight_id").orderBy("chunk")
    joins = (F.col("stretches") == 1) & (F.col("last") == F.lag("last").over(by_chunk))
    chained = tail.withColumn("chain", F.sum(F.when(joins, 0).otherwise(1)).over(by_chunk))
    so_far = W.Window.partitionBy("flight_id", "chain").orderBy("chunk")
    known = chained.withColumn("upto", F.max("tail_end").over(so_far))
    return known.select(
        "flight_id",
        "chunk",
        F.lag("last").over(by_chunk).alias("c_label"),
        F.lag("upto").over(by_chunk).alias("c_end"),
    )


_ORDER = ["flight_id", "chunk", "start_idx", "end_idx", "m", "h", "tie_m", "tie_h"]


def collapse_sorted(pdf: pd.DataFrame) -> pd.DataFrame:
    """Partial runs of whole, sorted chunks.  ``run_no`` counts from 1 within a
    chunk; 0 is the part that continues a run of an earlier chunk."""
    flight, chunk = pdf["flight_id"].to_numpy(), pdf["chunk"].to_numpy()
    label, start, end = pdf["label"].to_numpy(dtype=object), pdf["start_idx"].to_numpy(), pdf["end_idx"].to_numpy()
    n = len(pdf)
    opens = np.r_[True, (flight[1:] != flight[:-1]) | (chunk[1:] != chunk[:-1])]
    before = np.empty(n, object)
    before[1:] = label[:-1]
    before[opens] = pdf["c_label"].to_numpy(dtype=object)[opens]
    changed = label != before
    # largest end so far within the stretch of one label; a gap starts a new run
    # beyond every earlier end, so the stretch serves as well as the run itself
    never = np.iinfo(np.int64).min // 2
    carried = pdf["c_end"].fillna(never).to_numpy().astype(np.int64)
    first = opens & ~changed
    reach = np.where(first, np.maximum(end, carried), end)
    reach = pd.Series(reach).groupby(np.cumsum(opens | changed)).cummax().to_numpy()
    reach_before = np.r_[never, reach[:-1]]
    reach_before[opens] = carried[opens]
    boundary = changed | (start > reach_before + MAX_GAP) | (label == "")
    run_starts = np.flatnonzero(boundary)  # sorted run-start positions
    position = np.arange(n)
    run = np.searchsorted(run_starts, position, side="right")
    at_open = np.flatnonzero(opens)
    own_open = at_open[np.searchsorted(at_open, position, side="right") - 1]
    run_no = run - np.searchsorted(run_starts, own_open, side="left")
    known = label != ""
    if not known.any():
        return pd.DataFrame({c: pd.Series(dtype=object if c in ("maneuver", "heading") else "int64") for c in _COLUMNS})
    group = np.cumsum(np.r_[True, (run_no[1:] != run_no[:-1]) | opens[1:]])[known]
    first_of = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    at = np.flatnonzero(known)[first_of]
    return pd.DataFrame(
        {
            "flight_id": flight[at],
            "run_chunk": chunk[at],
            "run_no": run_no[at],
            "maneuver": pdf["m"].to_numpy()[at],
            "heading": pdf["h"].to_numpy()[at],
            "start_idx": np.minimum.reduceat(start[known], first_of),
            "end_idx": np.maximum.reduceat(end[known], first_of),
            "n_records": np.diff(np.r_[first_of, known.sum()]),
        }
    )


def _collapse_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Chunks arrive sorted; the last one of a batch waits for its remainder."""
    rest = None
    for pdf in batches:
        if rest is not None:
            pdf = pd.concat([rest, pdf], ignore_index=True)
        last = pdf.iloc[-1] if len(pdf) else None
        if last is None:
            continue
        tail = ((pdf["flight_id"] == last["flight_id"]) & (pdf["chunk"] == last["chunk"])).to_numpy()
        rest = pdf[tail]
        if not tail.all():
            yield collapse_sorted(pdf[~tail])
    if rest is not None and len(rest):
        yield collapse_sorted(rest)


def collapse_runs(segments: DataFrame) -> DataFrame:
    """One row per run (also runs of one record): flight_id, maneuver, heading,
    start_idx, end_idx, n_records.

    Defined results: records with null flight, null or impossible bounds are
    left out; records equal as written count once; records that tie in both
    bounds are ordered by meaning, then by spelling; a record of unknown
    maneuver or heading belongs to no run and ends the one before it; empty
    input gives no rows; further columns are ignored.
    """
    records = usable_records(segments)
    carries = chunk_carries(records)
    # explicit, so that no adaptive change of the join can part the rows of a chunk
    ready = records.join(carries, ["flight_id", "chunk"], "left").repartition("flight_id", "chunk").sortWithinPartitions(*_ORDER)
    parts = checkpointed(ready.mapInPandas(_collapse_batches, _PARTS))
    # a part with run_no 0 continues the latest part that began before it
    by_flight = W.Window.partitionBy("flight_id").orderBy("run_chunk")
    edge = parts.groupBy("flight_id", "run_chunk").agg(
        F.max("run_no").alias("last_no"), F.max(F.when(F.col("run_no") == 0, 1).otherwise(0)).alias("continues")
    )
    opened = edge.withColumn("opened", F.when(F.col("last_no") > 0, F.col("run_chunk")))
    origin = opened.select(
        "flight_id",
        "run_chunk",
        F.last("opened", ignorenulls=True).over(by_flight.rowsBetween(W.Window.unboundedPreceding, -1)).alias("from_chunk"),
    )
    origin_no = edge.where("last_no > 0").select("flight_id", F.col("run_chunk").alias("from_chunk"), F.col("last_no").alias("from_no"))
    linked = parts.where("run_no = 0").join(origin, ["flight_id", "run_chunk"]).join(origin_no, ["flight_id", "from_chunk"])
    moved = linked.select("flight_id", F.col("from_chunk").alias("run_chunk"), F.col("from_no").alias("run_no"), "maneuver", "heading", "start_idx", "end_idx", "n_records")
    whole = parts.where("run_no > 0").unionByName(moved)
    return whole.groupBy("flight_id", "run_chunk", "run_no").agg(
        F.first("maneuver").alias("maneuver"),
        F.first("heading").alias("heading"),
        F.min("start_idx").alias("start_idx"),
        F.max("end_idx").alias("end_idx"),
        F.sum("n_records").alias("n_records"),
    ).drop("run_chunk", "run_no")


def repeated_runs(runs: DataFrame) -> DataFrame:
    return runs.where("n_records > 1").select("flight_id", F.col("start_idx").alias("run_start_idx"), F.col("end_idx").alias("run_end_idx"))


def run_durations(runs: DataFrame, rows: DataFrame) -> DataFrame:
    """Runs with their duration in rows and, from the recorded times of the
    rows they cover, in seconds (null where no row has a time).

    Rows meet runs by an equi-join on (flight_id, block of rows), each run being
    listed in every block it touches: no range comparison across a whole flight.
    """
    keyed = runs.withColumn("run", F.struct("start_idx", "end_idx", "maneuver", "heading"))
    timed = (
        rows.where("flight_id is not null and row_idx is not null and time_s is not null and not isnan(time_s)")
        .select("flight_id", "row_idx", "time_s", F.floor(F.col("row_idx") / BLOCK).alias("block"))
    )
    # bounds cut to the rows there are: an absurd one lists no more blocks than its flight has
    span = timed.groupBy("flight_id").agg(F.min("row_idx").alias("_first"), F.max("row_idx").alias("_last"))
    cut = keyed.join(span, "flight_id").withColumn("low", F.greatest("start_idx", "_first")).withColumn("high", F.least("end_idx", F.col("_last") + 1)).where("low < high")
    blocks = cut.withColumn("block", F.explode(F.sequence(F.floor(F.col("low") / BLOCK), F.floor((F.col("high") - 1) / BLOCK))))
    covered = timed.join(blocks.select("flight_id", "block", "run"), ["flight_id", "block"]).where("row_idx >= run.start_idx and row_idx < run.end_idx")
    spans = covered.groupBy("flight_id", "run").agg((F.max("time_s") - F.min("time_s")).alias("seconds"))
    return keyed.join(spans, ["flight_id", "run"], "left").select(
        "flight_id", "maneuver", "heading", "start_idx", "end_idx", "n_records", (F.col("end_idx") - F.col("start_idx")).alias("n_rows"), F.round("seconds", 6).alias("seconds")
    )
