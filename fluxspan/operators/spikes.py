"""Implausible readings, judged against each source's own behaviour.

Every (flight, channel) series is decomposed by an undecimated interpolating
wavelet: a detail coefficient is a reading less the cubic course through the
readings 1, 2 or 4 places away, so a departure of up to three readings stands in
the details of one level in full.  Divided by a robust local scale they decide
on spikes: a block is proposed where all its details reach ``SPIKE_FACTOR``
times the usual scatter, and kept if the course goes on behind it as before.
Runs of details that vanish within the tolerance reveal stuck values, whose
exact range is then checked; the aircraft's bounds show impossible readings.

Flights are cut into chunks of rows that share ``HALO`` rows with their
neighbours, so one very long flight is spread over many tasks.  Where nulls
leave fewer than ``CONTEXT`` readings in a shared stretch, the missing ones are
brought from wherever the series has them.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from fluxspan.shared import overlapping_chunks

CHANNELS = ("b_total", "b_x", "roll_rate")
CHUNK, HALO = 8192, 192  # rows
CONTEXT = 120  # readings a chunk sees on either side of its own
STUCK_RUN = 10
STUCK_SHARE = 1 / 20
SPIKE_FACTOR = 8.0
MAX_BLOCK = 3
SIDE = 6  # readings on either side that carry the local course
STRETCH = 61  # readings over which the usual scatter is taken
GOES_ON = 0.25  # largest misfit of the neighbours' common curve, as a share of the deviation
CUBIC = np.array([-1.0, 9.0, 9.0, -1.0]) / 16  # middle value of the cubic through four even places
NOISE_GAIN = float(np.sqrt(1 + (CUBIC**2).sum()))  # scatter of a detail against that of a reading
LEVEL_OF = {1: 0, 2: 1, 3: 2}  # the finest level whose neighbours lie outside a block
COARSE = 1.5  # largest scale of a coarser level against the finest: the rest is course, not scatter

OUTPUT = "flight_id bigint, row_idx bigint, channel string, value double, out_of_limits boolean, stuck boolean, spike boolean, score double"


def wavelet_details(y: np.ndarray, levels: int = 3) -> list[np.ndarray]:
    """Detail coefficients of the undecimated interpolating wavelet, by level."""
    details, n = [], len(y)
    for level in range(levels):
        gap = 2**level
        wide = np.pad(y, 3 * gap, **({"mode": "reflect", "reflect_type": "odd"} if n > 3 * gap else {"mode": "edge"}))
        details.append(y - sum(c * wide[2 * k * gap : 2 * k * gap + n] for k, c in enumerate(CUBIC)))
    return details


def local_scale(r: np.ndarray, width: int = STRETCH, stride: int = 4) -> np.ndarray:
    """Robust scatter of ``r`` about zero over a sliding stretch of readings."""
    n = len(r)
    if n <= width:
        return np.full(n, 1.4826 * np.median(np.abs(r)))
    medians = np.median(sliding_window_view(np.abs(r), width)[::stride], axis=1)
    at = np.clip(np.round((np.arange(n) - width // 2) / stride).astype(int), 0, len(medians) - 1)
    return 1.4826 * medians[at]


def _course_weights(block: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Least-squares weights that predict a left-out block from its neighbours:
    both sides (quadratic), the left and the right side alone (linear), and the
    residual projector of the two-sided fit."""
    left, right = np.arange(-SIDE, 0), np.arange(block, block + SIDE)
    inside = np.arange(block)
    poly = lambda t, d: np.vander(t - (block - 1) / 2, d + 1)
    both = np.r_[left, right]
    solve = np.linalg.pinv(poly(both, 2))
    one = lambda t: poly(inside, 1) @ np.linalg.pinv(poly(t, 1))
    return poly(inside, 2) @ solve, one(left[-4:]), one(right[:4]), np.eye(2 * SIDE) - poly(both, 2) @ solve


_WEIGHTS = {w: _course_weights(w) for w in range(1, MAX_BLOCK + 1)}


def _pad(y: np.ndarray, by: int) -> np.ndarray:
    return np.pad(y, by, mode="reflect", reflect_type="odd")


def find_spikes(y: np.ndarray, factor: float = SPIKE_FACTOR) -> tuple[np.ndarray, np.ndarray]:
    """Flags and scores of the readings of one finite series that leave its course.

    Strongest first: accepted blocks are replaced by the course they left and
    the decomposition is repeated, so a large spike can't hide a small one.
    Every round flags readings not flagged before, or is the last.
    """
    n = len(y)
    flags, scores = np.zeros(n, bool), np.zeros(n)
    if n < 2 * SIDE + MAX_BLOCK:
        return flags, scores
    clean = y.astype(float).copy()
    tiny = np.finfo(float).eps * max(1.0, float(np.max(np.abs(y)))) * 16
    while True:
        details = wavelet_details(clean)
        scales = [np.maximum(local_scale(d), tiny) for d in details]
        scaled = [np.abs(d) / np.minimum(s, COARSE * scales[0]) for d, s in zip(details, scales)]
        scatter = scales[0] / NOISE_GAIN
        wide = _pad(clean, SIDE + MAX_BLOCK)
        best = np.full(n, np.inf)  # misfit of the neighbours, by first reading of the block
        width, power = np.zeros(n, int), np.zeros(n)
        for w, (fit, from_left, from_right, rest) in _WEIGHTS.items():
            within = np.arange(w)
            weakest = np.where(flags, 0.0, scaled[LEVEL_OF[w]])
            weakest = sliding_window_view(weakest, w).min(axis=1)
            starts = np.flatnonzero(weakest >= factor / NOISE_GAIN)
            at = starts + SIDE + MAX_BLOCK
            around = np.concatenate([wide[at[:, None] + np.arange(-SIDE, 0)], wide[at[:, None] + np.arange(w, w + SIDE)]], axis=1)
            off = np.abs(wide[at[:, None] + within] - around @ fit.T).min(axis=1)
            sides = np.abs(around[:, SIDE - 4 : SIDE] @ from_left.T - around[:, SIDE : SIDE + 4] @ from_right.T).max(axis=1)
            misfit = np.sqrt(((around @ rest.T) ** 2).mean(axis=1))
            # the course must go on as before: both sides foretell the same, and one curve fits them
            ok = (off > 0) & (sides <= 0.8 * off) & (misfit <= GOES_ON * off)
            better = ok & (misfit < best[starts])
            s = starts[better]
            best[s], width[s], power[s] = misfit[better], w, weakest[s] * NOISE_GAIN
        found = np.flatnonzero(np.isfinite(best))
        if not len(found):
            break
        free = np.ones(n + 2 * SIDE + MAX_BLOCK, bool)
        # of competing blocks, those that leave the calmest neighbourhood behind win
        gain = power[found] / (1 + best[found] / scatter[found])
        for s in found[np.argsort(-gain, kind="stable")]:
            w = width[s]
            if free[s : s + w + 2 * SIDE].all():
                free[s : s + w + 2 * SIDE] = False
                at = s + SIDE + MAX_BLOCK
                around = np.r_[wide[at - SIDE : at], wide[at + w : at + w + SIDE]]
                clean[s : s + w] = _WEIGHTS[w][0] @ around
                flags[s : s + w] = True
                scores[s : s + w] = power[s]
    return flags, scores


def stuck_readings(v: np.ndarray, tolerance: float, run: int = STUCK_RUN) -> np.ndarray:
    """Readings in a run of ``run`` or more that stay within ``tolerance``.  Only
    where the finest differences vanish so far is the exact range looked at."""
    stuck = np.zeros(len(v), bool)
    if len(v) < run or not np.isfinite(tolerance):
        return stuck
    with np.errstate(invalid="ignore"):
        still = np.r_[0, np.cumsum(np.abs(np.diff(v)) <= tolerance)]
        starts = np.flatnonzero(still[run - 1 :] - still[: len(v) - run + 1] == run - 1)
        windows = v[starts[:, None] + np.arange(run)]
        flat = starts[windows.max(axis=1, initial=-np.inf) - windows.min(axis=1, initial=np.inf) <= tolerance]
    stuck[(flat[:, None] + np.arange(run)).ravel()] = True
    return stuck


def judge_channel(v: np.ndarray, low: float, high: float, tolerance: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(out of limits, stuck, spike, score) for the readings of one series in
    row order.  NaN limits or tolerance switch that rule off."""
    with np.errstate(invalid="ignore"):
        outside = (v < low) | (v > high)
    stuck = stuck_readings(v, tolerance)
    spike, score = np.zeros(len(v), bool), np.zeros(len(v))
    plain = np.flatnonzero(~outside & ~stuck & np.isfinite(v))
    spike[plain], score[plain] = find_spikes(v[plain])
    return outside, stuck, spike, score


def _judge_chunk(key, rows: pd.DataFrame, limits: pd.DataFrame, size: int) -> pd.DataFrame:
    flight, chunk = key
    out = []
    if len(rows) and len(limits):
        rows = rows.drop_duplicates("row_idx").sort_values("row_idx", kind="stable")
        row_idx = rows["row_idx"].to_numpy()
        lim = limits.iloc[0]
        far = lim["far"] if lim["far"] is not None else []
        for channel in CHANNELS:
            v = rows[channel].to_numpy(dtype=float)
            read = ~np.isnan(v)
            at, v = row_idx[read], v[read]
            extra = {x["row_idx"]: x["value"] for x in far if x["channel"] == channel}
            if extra:
                at, first = np.unique(np.r_[at, np.fromiter(extra, np.int64)], return_index=True)
                v = np.r_[v, np.fromiter(extra.values(), float)][first]
            flags = judge_channel(v, lim[f"low_{channel}"], lim[f"high_{channel}"], lim[f"step_{channel}"] * STUCK_SHARE)
            mine = (flags[0] | flags[1] | flags[2]) & (at // size == chunk)
            if mine.any():
                out.append(
                    pd.DataFrame({"flight_id": flight, "row_idx": at[mine], "channel": channel, "value": v[mine], "out_of_limits": flags[0][mine], "stuck": flags[1][mine], "spike": flags[2][mine], "score": flags[3][mine]})
                )
    if out:
        return pd.concat(out, ignore_index=True)
    return pd.DataFrame({"flight_id": pd.Series(dtype="int64"), "row_idx": pd.Series(dtype="int64"), "channel": pd.Series(dtype=object), "value": pd.Series(dtype=float), "out_of_limits": pd.Series(dtype=bool), "stuck": pd.Series(dtype=bool), "spike": pd.Series(dtype=bool), "score": pd.Series(dtype=float)})


def steady_steps(once: DataFrame, size: int = CHUNK) -> DataFrame:
    """Median absolute step between successive readings in steady rows, by flight.

    ``percentile_approx`` merges bounded summaries, so a flight of any length
    needs no task that holds all its steps; its rank error is 1e-4.
    """
    before = W.Window.partitionBy("flight_id", "chunk").orderBy("row_idx").rowsBetween(W.Window.unboundedPreceding, -1)
    own = F.floor(F.col("row_idx") / size) == F.col("chunk")
    steps = once.select("flight_id", (own & F.col("steady")).alias("counts"), *[F.abs(F.col(c) - F.last(c, ignorenulls=True).over(before)).alias(c) for c in CHANNELS]).where("counts")
    return steps.groupBy("flight_id").agg(*[F.percentile_approx(F.when(~F.isnan(c), F.col(c)), 0.5, 10000).alias(f"step_{c}") for c in CHANNELS])


def chunk_counts(once: DataFrame, size: int = CHUNK) -> DataFrame:
    """Per chunk that owns rows: readings of its own (n), in the rows shared with
    the chunk before (left) and after it (right), by channel."""
    start, row = F.col("chunk") * size, F.col("row_idx")
    where = {"n": (row >= start) & (row < start + size), "left": row < start, "right": row >= start + size}
    counts = [F.count_if(inside & F.col(c).isNotNull()).alias(f"{name}_{c}") for c in CHANNELS for name, inside in where.items()]
    found = once.groupBy("flight_id", "chunk").agg(F.count_if(where["n"]).alias("rows"), *counts)
    # readings can't outnumber rows; the comparison keeps all counts, and with them the shared exchange
    return found.where((F.col("rows") > 0) & (F.greatest(*[f"n_{c}" for c in CHANNELS]) <= F.col("rows"))).drop("rows")


def far_readings(once: DataFrame, counts: DataFrame, size: int = CHUNK, context: int = CONTEXT) -> DataFrame:
    """Readings from beyond the shared rows that a chunk needs, where nulls leave
    fewer than ``context`` of them there: flight_id, chunk, far.

    Every chunk knows how many readings come before and behind it; the sources
    of what it lacks are the chunks whose last (or first) reading is less than
    ``context`` readings away, at most ``context`` of them.
    """
    channels = F.explode(F.array(*[F.struct(F.lit(c).alias("channel"), *[F.col(f"{x}_{c}").alias(x) for x in ("n", "left", "right")]) for c in CHANNELS])).alias("c")
    series = W.Window.partitionBy("flight_id", "channel").orderBy("chunk")
    per = counts.select("flight_id", "chunk", channels).select("flight_id", "chunk", "c.*")
    per = per.withColumn("upto", F.sum("n").over(series.rowsBetween(W.Window.unboundedPreceding, 0))).withColumn("total", F.sum("n").over(W.Window.partitionBy("flight_id", "channel")))
    ahead, behind = F.col("upto") - F.col("n"), F.col("total") - F.col("upto")
    marks = F.array(
        F.struct(F.lit("left").alias("side"), F.col("upto").alias("mark"), F.lit(False).alias("asks"), (F.col("n") > 0).alias("counts")),
        F.struct(F.lit("right").alias("side"), (behind + F.col("n")).alias("mark"), F.lit(False).alias("asks"), (F.col("n") > 0).alias("counts")),
        F.struct(F.lit("left").alias("side"), ahead.alias("mark"), F.lit(True).alias("asks"), (F.col("left") < F.least(F.lit(context), ahead)).alias("counts")),
        F.struct(F.lit("right").alias("side"), behind.alias("mark"), F.lit(True).alias("asks"), (F.col("right") < F.least(F.lit(context), behind)).alias("counts")),
    )
    marked = per.select("flight_id", "channel", "chunk", F.explode(marks).alias("m")).where("m.counts").select("flight_id", "channel", "chunk", "m.side", "m.mark", "m.asks")
    near = W.Window.partitionBy("flight_id", "channel", "side").orderBy("mark").rangeBetween(-(context - 1), 0)
    asked = marked.withColumn("sources", F.collect_list(F.when(~F.col("asks"), F.col("chunk"))).over(near)).where("asks")
    links = asked.select("flight_id", "channel", "side", F.col("chunk").alias("asker"), F.explode("sources").alias("chunk")).where("chunk != asker")
    # part of the value, not a filter of its own that would sink below the shared exchange
    own = F.floor(F.col("row_idx") / size) == F.col("chunk")
    value = F.coalesce(*[F.when(own & (F.col("channel") == c), F.col(c)) for c in CHANNELS])
    read = once.join(links, ["flight_id", "chunk"]).select("flight_id", "channel", "side", "asker", "row_idx", value.alias("value")).where("value is not null")
    distance = F.when(F.col("side") == "left", -F.col("row_idx")).otherwise(F.col("row_idx"))
    ranked = read.withColumn("rank", F.row_number().over(W.Window.partitionBy("flight_id", "asker", "channel", "side").orderBy(distance))).where(F.col("rank") <= context)
    return ranked.groupBy("flight_id", F.col("asker").alias("chunk")).agg(F.collect_list(F.struct("channel", "row_idx", "value")).alias("far"))


def implausible_readings(rows: DataFrame, flights: DataFrame, aircraft: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """All implausible readings with the rule(s) they break.

    Defined results: deliveries of one (flight_id, row_idx) count once; rows
    without flight_id or row_idx can't be placed and are left out; null and NaN
    are no readings; a flight without known aircraft has no limits (rule a is
    off), one without steady rows no stuck tolerance (rule b is off); empty
    input gives no rows; further columns are ignored.
    """
    parts = (
        rows.where("flight_id is not null and row_idx is not null")
        .select(
            F.col("flight_id").cast("bigint").alias("flight_id"),
            F.col("row_idx").cast("bigint").alias("row_idx"),
            # one column, so that all uses of the rows need the same ones and share one exchange
            F.array(*[F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")) for c in CHANNELS], F.coalesce(F.col("segment").rlike("^steady_[NESW]$"), F.lit(False)).cast("double")).alias("read"),
        )
        .select("*", F.explode(overlapping_chunks(F.col("row_idx"), chunk, HALO)).alias("chunk"))
        .repartition("flight_id", "chunk")
    )
    unpacked = ["flight_id", "chunk", "row_idx", *[F.col("read")[i].alias(c) for i, c in enumerate(CHANNELS)]]
    once = parts.dropDuplicates(["flight_id", "chunk", "row_idx"]).select(*unpacked, (F.col("read")[len(CHANNELS)] == 1).alias("steady"))
    counts = chunk_counts(once, chunk)
    known = flights.select("flight_id", "aircraft_id").where("flight_id is not null").dropDuplicates(["flight_id"])
    craft = aircraft.select("aircraft_id", "mag_min_nt", "mag_max_nt", "fluxgate_max_nt", "max_rate_rad_s").dropDuplicates(["aircraft_id"])
    limits = (
        counts.select("flight_id", "chunk")
        .join(far_readings(once, counts, chunk), ["flight_id", "chunk"], "left")
        .join(steady_steps(once, chunk), "flight_id", "left")
        .join(known.join(craft, "aircraft_id", "left"), "flight_id", "left")
        .select(
            F.col("flight_id").alias("of_flight"),
            F.col("chunk").alias("of_chunk"),
            "far",
            *[f"step_{c}" for c in CHANNELS],
            F.col("mag_min_nt").alias("low_b_total"),
            F.col("mag_max_nt").alias("high_b_total"),
            (-F.col("fluxgate_max_nt")).alias("low_b_x"),
            F.col("fluxgate_max_nt").alias("high_b_x"),
            (-F.col("max_rate_rad_s")).alias("low_roll_rate"),
            F.col("max_rate_rad_s").alias("high_roll_rate"),
        )
    )
    return parts.select(*unpacked).groupBy("flight_id", "chunk").cogroup(limits.groupBy("of_flight", "of_chunk")).applyInPandas(lambda key, left, right: _judge_chunk(key, left, right, chunk), OUTPUT)
