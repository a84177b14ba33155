"""Irregular readings onto a regular grid, gaps filled by singular spectra.

Readings are averaged into cells of one second.  Between two readings that
follow each other within ``MAX_PAUSE`` seconds every empty cell is filled by
iterative singular-spectrum imputation: the bucketed series is embedded in a
Hankel trajectory matrix, the leading singular vectors are kept, the missing
entries are replaced by the reconstruction, and this is repeated until they
settle.  Longer breaks are pauses; nothing is filled there.

Holes longer than the series' own rhythm can't be reached by such rounds from a
straight line: they start from the linear recurrence of the leading singular
vectors of the known stretches on either side, if that recurrence foretells
the known cells next to the hole clearly better than standing still does.

Cells are handled in overlapping chunks of time, so a flight of any length is
spread over many tasks.  A hole is filled by the chunk in which it begins; the
overlap is wider than the longest fillable gap and its surroundings.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fluxspan.shared import overlapping_chunks

CHANNELS = ("b_total", "b_x")
MAX_PAUSE = 900.0
CHUNK, HALO = 4096, 2048  # cells; the halo holds the longest gap and its right surroundings
SHORT = 8  # holes of up to so many cells are imputed together with their neighbours
EMBED, EMBED_LONG = 12, 96  # longest Hankel windows, in cells
SURROUNDINGS = 72  # known cells looked at on either side of a long hole, at least
KEEP_ENERGY = 0.9999
RANKS = (2, 4, 8, 12)
MAX_ROUNDS = 20
SETTLED = 2e-3
TRUSTED = 0.5  # largest error of a recurrence against that of standing still

OUTPUT = "flight_id bigint, cell bigint, channel string, value double, status string"


def trajectories(x: np.ndarray, window: int) -> np.ndarray:
    """Hankel matrix of ``x``: one row per lag."""
    return np.ascontiguousarray(sliding_window_view(x, len(x) - window + 1))


def leading_vectors(products: np.ndarray, most: int) -> np.ndarray:
    """Singular vectors that hold ``KEEP_ENERGY``, at most ``most``."""
    energy, vectors = np.linalg.eigh(products)
    energy = np.maximum(energy[::-1], 0)
    rank = int(np.searchsorted(np.cumsum(energy), KEEP_ENERGY * energy.sum())) + 1
    return vectors[:, ::-1][:, : min(rank, most, len(energy))]


def recurrence(basis: np.ndarray) -> np.ndarray | None:
    """Weights by which a series in this subspace follows from its past."""
    share = float(basis[-1] @ basis[-1])
    return (basis[:-1] @ basis[-1]) / (1 - share) if share < 0.999 else None


def foretold(past: np.ndarray, weights: np.ndarray, steps: int) -> np.ndarray:
    known = len(weights)
    out = np.r_[past[-known:], np.zeros(steps)]
    bound = 10 * float(np.max(np.abs(past))) + 1e-300
    for t in range(steps):
        out[known + t] = min(bound, max(-bound, float(weights @ out[t : t + known])))
    return out[known:]


def plausible(x: np.ndarray, known: np.ndarray) -> np.ndarray:
    """``known`` without cells far off their neighbours: such a reading stays in
    the grid, but must not shape what is filled in around it."""
    v = x[known]
    if len(v) < 9:
        return known
    off = np.abs(v - np.median(sliding_window_view(np.pad(v, 4, mode="edge"), 9), axis=1))
    limit = 1.4826 * max(8 * float(np.median(off)), 3 * float(np.median(np.abs(v - np.median(v)))))
    out = known.copy()
    if limit > 0:
        out[known] = off <= limit
    return out


def _first_guess(y: np.ndarray, a: int, b: int, window: int) -> tuple[np.ndarray, int] | None:
    """Values of cells a..b from the recurrences of both sides, and their rank;
    None where they can't be trusted."""
    sides = [(side, flipped) for side, flipped in ((y[:a], False), (y[b:][::-1], True)) if len(side) >= 2 * window]
    if not sides:
        return None
    whole = np.hstack([trajectories(side[::-1] if flipped else side, window) for side, flipped in sides])
    products = whole @ whole.T
    best = None
    for rank in RANKS:
        basis = leading_vectors(products, rank)
        rules = [recurrence(basis[::-1] if flipped else basis) for _, flipped in sides]
        if any(r is None for r in rules):
            continue
        errors = []
        for (side, _), rule in zip(sides, rules):
            last = min(b - a, len(side) // 3, window)
            still = float(np.mean((side[-last:] - side[-last - 1]) ** 2))
            errors.append(float(np.mean((foretold(side[:-last], rule, last) - side[-last:]) ** 2)) / max(still, 1e-300))
        if best is None or max(errors) < best[0]:
            best = (max(errors), rules, basis.shape[1])
    if best is None or not best[0] < TRUSTED**2:
        return None
    weight = np.zeros(b - a)
    total = np.zeros(b - a)
    falling = 1 - np.arange(1, b - a + 1) / (b - a + 1)
    for (side, flipped), rule in zip(sides, best[1]):
        ahead, share = foretold(side, rule, b - a), falling
        if flipped:
            ahead, share = ahead[::-1], falling[::-1]
        total += share * ahead
        weight += share
    return total / weight, best[2]


def ssa_impute(x: np.ndarray, missing: np.ndarray, longest: int = EMBED, hole: tuple[int, int] | None = None) -> np.ndarray:
    """Fill the missing entries of one series.

    ``hole`` names a long run of missing cells that may start from recurrences;
    all others start from linear interpolation, and a series with fewer than
    eight known values, or without spread, keeps it.  What the reconstruction
    misses next to each filled stretch is bridged linearly.
    """
    known = ~missing
    at = np.arange(len(x))
    out = x.astype(float).copy()
    if not known.any():
        return out
    out[missing] = np.interp(at[missing], at[known], x[known])
    used = plausible(x, known)
    spread = float(np.std(x[used])) if used.any() else 0.0
    if not missing.any() or used.sum() < 8 or not np.isfinite(spread) or spread == 0:
        return out
    centre = float(np.median(x[used]))
    low, high = float(x[used].min()) - centre, float(x[used].max()) - centre
    y = np.interp(at, at[used], x[used]) - centre
    most = RANKS[-1]
    if hole is None:
        window = min(longest, len(x) // 2)
    else:
        a, b = hole
        window = min(longest, max(8, max(a, len(x) - b) // 3))
        if guess := _first_guess(y, a, b, window):
            y[a:b], most = np.clip(guess[0], low, high), max(4, guess[1])
    hidden = np.flatnonzero(~used)
    overlap = np.convolve(np.ones(len(y) - window + 1), np.ones(window))
    was = step_was = None
    for _ in range(MAX_ROUNDS):
        embedded = trajectories(y, window)
        basis = leading_vectors(embedded @ embedded.T, min(most, window // 2))
        smooth = sum(map(np.convolve, basis.T, basis.T @ embedded)) / overlap
        new = smooth[hidden]
        step = new - y[hidden]
        if step @ step <= (SETTLED * spread) ** 2 * len(hidden):
            break
        # the rounds approach their limit along few directions: a secant shortens them
        aim = new
        if was is not None and (turn := (step - step_was) @ (step - step_was)) > 0:
            aim = np.clip(new - (step @ (step - step_was)) / turn * (new - was), low, high)
        y[hidden], was, step_was = aim, new, step
    rest = np.interp(at, at[used], (x - centre - smooth)[used])
    out[missing] = np.clip((smooth + rest)[missing], low, high) + centre
    return out


def hole_groups(hole: np.ndarray, mine: np.ndarray) -> list[tuple[int, int]]:
    """(first, behind the last) of each group of holes that is imputed at once:
    a long hole alone, short ones with those within one window of them.  Only
    holes that begin in a cell of ``mine`` are listed."""
    at = np.flatnonzero(hole)
    runs = np.split(at, np.flatnonzero(np.diff(at) > 1) + 1) if len(at) else []
    groups: list[list[int]] = []
    for run in runs:
        a, b = int(run[0]), int(run[-1]) + 1
        if not mine[a]:
            continue
        short = b - a <= SHORT
        if short and groups and groups[-1][2] and a - groups[-1][1] <= EMBED and b - groups[-1][0] <= 8 * EMBED:
            groups[-1][1] = b
        else:
            groups.append([a, b, short])
    return [(a, b) for a, b, _ in groups]


def impute_holes(x: np.ndarray, hole: np.ndarray, mine: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``x`` with every group of holes that begins in a cell of ``mine`` filled
    from its surroundings, and which cells were filled."""
    out, done = x.copy(), np.zeros(len(x), bool)
    for a, b in hole_groups(hole, mine):
        alone = b - a > SHORT and bool(hole[a:b].all())
        reach = max(SURROUNDINGS, min(2 * (b - a), HALO - int(MAX_PAUSE) - 2)) if alone else 3 * EMBED
        left, right = max(0, a - reach), min(len(x), b + reach)
        filled = ssa_impute(x[left:right], hole[left:right], EMBED_LONG if alone else EMBED, (a - left, b - left) if alone else None)
        own = np.flatnonzero(hole[a:b]) + a
        out[own], done[own] = filled[own - left], True
    return out, done


def fill_cells(cell: np.ndarray, first: np.ndarray, last: np.ndarray, mean: np.ndarray, max_pause: float = MAX_PAUSE, own: tuple[int, int] | None = None):
    """(cells, values, filled?) of one channel of one chunk.

    ``cell`` holds the occupied cells in order, ``first`` and ``last`` the times
    of their first and last reading, ``mean`` their value (NaN where no finite
    reading stands in it).  ``own``: only occupied cells in this range, and holes
    that begin in it, come out.
    """
    low, high = own or (int(cell[0]), int(cell[-1]) + 1)
    joined = first[1:] - last[:-1] <= max_pause
    cells, values, filled = [], [], []
    borders = np.r_[0, np.flatnonzero(~joined) + 1, len(cell)]
    for a, b in zip(borders[:-1], borders[1:]):
        if cell[b - 1] < low or cell[a] >= high:
            continue
        grid = np.arange(cell[a], cell[b - 1] + 1)
        mine = (grid >= low) & (grid < high)
        x = np.full(len(grid), np.nan)
        x[cell[a:b] - cell[a]] = mean[a:b]
        vacant = np.ones(len(grid), bool)
        vacant[cell[a:b] - cell[a]] = False
        hole = np.isnan(x)
        done = np.zeros(len(grid), bool)
        if hole.any():
            x, done = impute_holes(x, hole, mine)
        keep = (mine & ~hole) | done
        cells.append(grid[keep])
        values.append(x[keep])
        filled.append(vacant[keep])
    if not cells:
        return np.zeros(0, np.int64), np.zeros(0), np.zeros(0, bool)
    return np.concatenate(cells), np.concatenate(values), np.concatenate(filled)


def _fill_chunk(key, pdf: pd.DataFrame, size: int) -> pd.DataFrame:
    flight, chunk = key
    out = []
    pdf = pdf.sort_values("cell", kind="stable")
    for channel in CHANNELS:
        first = pdf[f"first_{channel}"].to_numpy(dtype=float)
        used = ~np.isnan(first)
        if not used.any():
            continue
        last, mean = (pdf[f"{what}_{channel}"].to_numpy(dtype=float)[used] for what in ("last", "mean"))
        cells, values, filled = fill_cells(pdf["cell"].to_numpy()[used], first[used], last, mean, own=(chunk * size, (chunk + 1) * size))
        out.append(pd.DataFrame({"flight_id": flight, "cell": cells, "channel": channel, "value": values, "status": np.where(filled, "filled", "observed")}))
    if out:
        return pd.concat(out, ignore_index=True)
    return pd.DataFrame({"flight_id": pd.Series(dtype="int64"), "cell": pd.Series(dtype="int64"), "channel": pd.Series(dtype=object), "value": pd.Series(dtype=float), "status": pd.Series(dtype=object)})


def occupied_cells(rows: DataFrame) -> DataFrame:
    """One row per (flight, second) with any usable reading: first and last time
    and mean of each channel.  Deliveries of a row count once.  One exchange, on
    (flight_id, cell), serves both the deduplication and the averages."""
    usable = lambda c: F.col(c).isNotNull() & ~F.isnan(c)
    once = (
        rows.select("flight_id", "row_idx", F.col("time_s").cast("double").alias("time_s"), *[F.col(c).cast("double").alias(c) for c in CHANNELS])
        .where(F.col("flight_id").isNotNull() & usable("time_s") & (F.abs("time_s") < 1e15))
        .where(usable(CHANNELS[0]) | usable(CHANNELS[1]))
        .withColumn("cell", F.floor("time_s").cast("bigint"))
        .repartition("flight_id", "cell")
        .dropDuplicates(["flight_id", "cell", "row_idx", "time_s", *CHANNELS])
    )
    finite = lambda c: usable(c) & (F.abs(c) < float("inf"))
    stats = []
    for c in CHANNELS:
        stats += [
            F.min(F.when(usable(c), F.col("time_s"))).alias(f"first_{c}"),
            F.max(F.when(usable(c), F.col("time_s"))).alias(f"last_{c}"),
            F.avg(F.when(finite(c), F.col(c))).alias(f"mean_{c}"),
        ]
    return once.groupBy("flight_id", "cell").agg(*stats)


def regular_grid(rows: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """One value per whole second, flight and channel, outside pauses.

    ``status`` is ``observed`` where the second holds a usable reading and
    ``filled`` where it had none; a second that holds only infinite readings is
    observed, with an imputed value.  Defined results: rows without flight_id,
    with null, NaN or infinite ``time_s``, or without a usable channel are left
    out; order and repeated deliveries don't matter; empty input gives no rows.
    """
    chunked = occupied_cells(rows).withColumn("chunk", F.explode(overlapping_chunks(F.col("cell"), chunk, HALO)))
    return chunked.groupBy("flight_id", "chunk").applyInPandas(lambda key, pdf: _fill_chunk(key, pdf, chunk), OUTPUT)
