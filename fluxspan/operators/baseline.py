"""Earth-field baselines and the interference left above them."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fluxspan.config import PipelineConfig
from fluxspan.functions.ordered import join_flights, with_keys
from fluxspan.schema import COL_ALT, COL_BTOTAL, COL_DELTA_B, COL_LAT, COL_LON, FLIGHT, ROW

EARTH_RADIUS = 6371.2  # km, reference radius of the field model; fixed value
WGS84 = (6378.137, 6356.752314245)  # semi-axes in km; fixed values


def steady_mean(df: DataFrame, mask: str | None = None) -> DataFrame:
    """flight_id, baseline and the flight's last position: the mean total field
    over the rows marked by column ``mask`` (all rows without one).  A flight
    without marked rows is an error when computed."""
    value = F.col(COL_BTOTAL) if mask is None else F.when(F.col(mask), F.col(COL_BTOTAL))
    means = with_keys(df).groupBy(FLIGHT).agg(F.avg(value).alias("_mean"), F.max(ROW).alias("_last"))
    nothing = F.raise_error(F.concat(F.lit("no steady rows in flight "), F.col(FLIGHT).cast("string"))).cast("double")
    return means.select(FLIGHT, "_last", F.coalesce("_mean", nothing).alias("baseline"))


def read_shc(path: str) -> tuple[np.ndarray, dict[tuple[int, int], np.ndarray]]:
    """Epochs and coefficients {(n, m): values} of a spherical-harmonic
    coefficient file in the public SHC layout."""
    lines = [x for x in open(path).read().splitlines() if x.strip() and not x.startswith("#")]
    epochs = np.array([float(x) for x in lines[1].split()])
    table = {}
    for line in lines[2:]:
        n, m, *values = line.split()
        table[int(n), int(m)] = np.array([float(v) for v in values])
    return epochs, table


def coefficients_at(epochs: np.ndarray, table: dict, when: dt.date) -> dict[tuple[int, int], float]:
    """Linear interpolation in time; the last interval is continued."""
    start = dt.date(when.year, 1, 1)
    year = when.year + (when - start).days / ((dt.date(when.year + 1, 1, 1) - start).days)
    k = int(np.clip(np.searchsorted(epochs, year, side="right") - 1, 0, max(0, len(epochs) - 2)))
    if len(epochs) == 1:
        return {nm: float(v[0]) for nm, v in table.items()}
    share = (year - epochs[k]) / (epochs[k + 1] - epochs[k])
    return {nm: float(v[k] + share * (v[k + 1] - v[k])) for nm, v in table.items()}


def field_strength(lon: np.ndarray, lat: np.ndarray, alt_km: np.ndarray, g: dict[tuple[int, int], float]) -> np.ndarray:
    """Total intensity of a main-field model at geodetic positions.

    Coefficients are Schmidt semi-normalised; m >= 0 holds g, m < 0 holds h.
    Legendre functions follow the usual recursion in degree along each order.
    """
    a, b = WGS84
    phi, lam = np.radians(lat), np.radians(lon)
    bend = np.sqrt((a * np.cos(phi)) ** 2 + (b * np.sin(phi)) ** 2)
    x, z = (a * a / bend + alt_km) * np.cos(phi), (b * b / bend + alt_km) * np.sin(phi)
    r = np.hypot(x, z)
    cos_t, sin_t = z / r, np.maximum(x / r, 1e-10)
    top = max((n for n, _ in g), default=0)
    up = north = east = np.zeros_like(r)
    up, north, east = up.copy(), north.copy(), east.copy()
    diagonal, slope_diagonal = np.ones_like(r), np.zeros_like(r)
    for m in range(top + 1):
        if m:
            factor = 1.0 if m == 1 else np.sqrt((2 * m - 1) / (2 * m))
            slope_diagonal = factor * (cos_t * diagonal + sin_t * slope_diagonal)
            diagonal = factor * sin_t * diagonal
        older, slope_older = np.zeros_like(r), np.zeros_like(r)
        p, slope = diagonal, slope_diagonal
        for n in range(m, top + 1):
            if n > m:
                low, high = np.sqrt((n - 1) ** 2 - m * m), np.sqrt(n * n - m * m)
                new = ((2 * n - 1) * cos_t * p - low * older) / high
                slope_new = ((2 * n - 1) * (cos_t * slope - sin_t * p) - low * slope_older) / high
                older, slope_older, p, slope = p, slope, new, slope_new
            if n == 0:
                continue
            gc, hs = g.get((n, m), 0.0), g.get((n, -m), 0.0) if m else 0.0
            wave, turn = gc * np.cos(m * lam) + hs * np.sin(m * lam), m * (hs * np.cos(m * lam) - gc * np.sin(m * lam))
            scale = (EARTH_RADIUS / r) ** (n + 2)
            up += (n + 1) * scale * wave * p
            north += scale * wave * slope
            east -= scale * turn * p / sin_t
    return np.sqrt(up**2 + north**2 + east**2)


def model_baseline(df: DataFrame, g: dict[tuple[int, int], float]) -> DataFrame:
    """``df`` with ``baseline`` from the coefficients of a main-field model (a few
    hundred numbers).  Altitude is in km."""

    @F.pandas_udf("double")
    def strength(lon: pd.Series, lat: pd.Series, alt: pd.Series) -> pd.Series:
        return pd.Series(field_strength(lon.to_numpy(float), lat.to_numpy(float), alt.to_numpy(float), g))

    return df.withColumn("baseline", strength(COL_LON, COL_LAT, COL_ALT))


def compute_interference(df: DataFrame, config: PipelineConfig, steady_mask: str | None = None, coefficient_file: str | None = None) -> DataFrame:
    """``df`` with ``delta_B`` = total field less the baseline of the configured
    method.  The means of all flights join back by flight and chunk."""
    if config.earth_field_method == "steady_mean":
        keyed = with_keys(df)
        based = join_flights(keyed, steady_mean(keyed, steady_mask))
    else:
        if not coefficient_file:
            raise ValueError("the main-field baseline needs a coefficient file (public SHC layout); pass coefficient_file=")
        based = model_baseline(with_keys(df), coefficients_at(*read_shc(coefficient_file), config.igrf_date))
    return based.withColumn(COL_DELTA_B, F.col(COL_BTOTAL) - F.col("baseline")).drop("baseline")
