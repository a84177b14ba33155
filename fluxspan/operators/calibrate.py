"""Fitting interference coefficients: pooled, by heading, by maneuver, by flight.

One pass over the stacked segment rows yields triangular factors per group (and
per cross-validation block); models of all groups are solved on the executors
and come back as a table with one row per group.
"""

from __future__ import annotations

import warnings
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from fluxspan.config import PipelineConfig
from fluxspan.functions.ordered import with_keys
from fluxspan.operators import linalg
from fluxspan.operators.features import add_features, dot, needs_neighbours
from fluxspan.operators.segments import check_segments, folded_mean, rows_in_segments
from fluxspan.schema import COL_DELTA_B, COL_HEADING, FLIGHT, MANEUVERS, ROW, TERMS

FEW_SAMPLES = 10_000  # recommended rows for models c and d

MODEL = "n bigint, coefficients array<double>, condition_number double, singular_values array<double>, selected_alpha double, effective_dof double, vif array<double>"


@dataclass(frozen=True)
class CalibrationResult:
    coefficients: np.ndarray
    residuals: DataFrame | None  # model less data, keyed by flight, segment and row; lazy
    condition_number: float
    singular_values: np.ndarray
    n_terms: int
    selected_alpha: float | None = None
    effective_dof: float | None = None
    n_samples: int = 0


@dataclass(frozen=True)
class HeadingCalibrationResult:
    per_heading: dict[str, CalibrationResult]
    per_heading_vif: dict[str, np.ndarray]
    reference_heading_deg: float


@dataclass(frozen=True)
class AdaptiveCalibrationResult:
    pitch: CalibrationResult
    roll: CalibrationResult
    yaw: CalibrationResult
    baseline: CalibrationResult
    n_terms: int


def stacked(df: DataFrame, segments: DataFrame, config: PipelineConfig) -> DataFrame:
    """Rows of all segments with their terms; derivatives stay within a segment."""
    return add_features(rows_in_segments(df, segments), config, (FLIGHT, "seg_ord"))


SPAN = 4096  # segments whose lengths are added up in one task


def stacked_offsets(segments: DataFrame, keys: list[str]) -> DataFrame:
    """Per segment: its offset in the stacked order of its group (flight, then
    segment order) and the size of the group, from which rows know their block.

    Lengths are added up within spans of a flight's segments; over all flights
    there is one row per span to go through.
    """
    names = {"heading": "seg_heading", "maneuver": "seg_maneuver"}
    length = F.col("end_idx") - F.col("start_idx")
    renamed = segments.select(FLIGHT, "seg_ord", F.col("maneuver").alias("seg_maneuver"), F.col("heading").alias("seg_heading"), length.alias("_len"), F.floor(F.col("seg_ord") / SPAN).alias("_span"))
    by = [names.get(c, c) for c in keys]
    place = list(dict.fromkeys([*by, FLIGHT, "_span"]))
    spans = renamed.groupBy(*place).agg(F.sum("_len").alias("_sum"))
    order = W.Window.partitionBy(*by).orderBy(FLIGHT, "_span")
    spans = spans.select(*place, F.coalesce(F.sum("_sum").over(order.rowsBetween(W.Window.unboundedPreceding, -1)), F.lit(0)).alias("_start"), F.sum("_sum").over(W.Window.partitionBy(*by)).alias("_total"))
    inside = W.Window.partitionBy(*place).orderBy("seg_ord").rowsBetween(W.Window.unboundedPreceding, -1)
    own = renamed.withColumn("_within", F.coalesce(F.sum("_len").over(inside), F.lit(0)))
    return own.join(spans, place).select(FLIGHT, "seg_ord", (F.col("_start") + F.col("_within")).alias("_ahead"), "_total")


def _with_block(rows: DataFrame, segments: DataFrame, keys: list[str], config: PipelineConfig) -> DataFrame:
    if not config.use_cv:
        return rows.withColumn("block", F.lit(0))
    k = config.cv_folds
    placed = rows.join(stacked_offsets(segments, keys), [FLIGHT, "seg_ord"])
    size = F.floor(F.col("_total") / (k + 1))
    at = F.col("_ahead") + F.col(ROW) - F.col("start_idx") - (F.col("_total") - k * size)
    return placed.withColumn("block", F.when(at < 0, 0).otherwise(F.floor(at / size) + 1).cast("int")).drop("_ahead", "_total")


def solve(parts: dict[int, linalg.Part], config: PipelineConfig) -> dict:
    """Model of one group from its block factors."""
    whole = linalg.Part.merged(list(parts.values()))
    k, n = whole.k, whole.n
    sigma = np.linalg.svd(whole.a, compute_uv=False)[: min(n, k)]
    condition = float(sigma[0] / sigma[-1]) if len(sigma) and sigma[-1] > 0 else float("inf")
    cv = config.use_cv and all(b in parts for b in range(config.cv_folds + 1))
    if config.use_cv and not cv and (config.use_ridge or config.use_lasso or config.use_elastic_net):
        raise ValueError(f"too few rows ({n}) for {config.cv_folds} folds")
    alpha = dof = None
    plain = not (config.use_ridge or config.use_lasso or config.use_elastic_net)
    if config.use_ridge or (plain and config.auto_regularize and condition > config.condition_number_threshold):
        alpha = linalg.ridge_search(parts, config.cv_folds) if cv else config.ridge_alpha
        w = linalg.solve_ridge(whole, alpha)
        dof = float(np.sum(sigma**2 / (sigma**2 + alpha)))
    elif plain:
        w = linalg.solve_ols(whole)
    else:
        ratio, alpha = (1.0, config.lasso_alpha) if config.use_lasso else (config.elastic_net_l1_ratio, config.elastic_net_alpha)
        inner = linalg.elastic_search(parts, config.cv_folds, whole, ratio) if cv else alpha / (2 * n)
        w, alpha = linalg.solve_elastic(whole, inner, ratio), inner * 2 * n
        dof = float(np.count_nonzero(w))
    try:
        vif = linalg.vif_from(whole)
    except ValueError:
        vif = np.full(k, np.nan)
    return {"n": n, "coefficients": w.tolist(), "condition_number": condition, "singular_values": sigma.tolist(), "selected_alpha": alpha, "effective_dof": dof, "vif": vif.tolist()}


def tree_reduced(parts: DataFrame, keys: list[str], width: int, fan: int = 256) -> DataFrame:
    """Factors of at most ``fan`` tasks' worth per key: with very many tasks the
    last step would otherwise gather one factor of each."""
    types = {f.name: f.dataType.simpleString() for f in parts.schema.fields}
    ddl = ", ".join(f"{c} {types[c]}" for c in keys)

    def merge(key, pdf: pd.DataFrame) -> pd.DataFrame:
        part = linalg.Part.merged(linalg.read_parts(pdf, width))
        return pd.DataFrame([dict(zip(keys, key)) | {"n": part.n, "sums": part.sums.tolist(), "r": part.r.ravel().tolist()}])

    spread = parts.withColumn("_fan", F.pmod(F.spark_partition_id(), F.lit(fan)))
    return spread.groupBy(*keys, "_fan").applyInPandas(merge, (ddl + ", " if ddl else "") + "n bigint, sums array<double>, r array<double>")


def fit_models(df: DataFrame, segments: DataFrame, config: PipelineConfig, keys: list[str], rows: DataFrame | None = None) -> DataFrame:
    """One model per group of ``keys`` (any of flight_id, heading, maneuver; none
    fits all rows together): the keys and the columns of ``MODEL``.

    A flight with a large share of all rows is no hot spot: rows are reduced
    where they are, before anything is grouped.
    """
    names = {"heading": "seg_heading", "maneuver": "seg_maneuver"}
    columns = [names.get(c, c) for c in keys]
    terms = list(TERMS[config.model_terms])
    rows = stacked(df, segments, config) if rows is None else rows
    rows = _with_block(rows, segments, keys, config).select(*columns, "block", *terms, COL_DELTA_B)
    types = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    ddl = ", ".join(f"{c} {types[c]}" for c in [*columns, "block"])
    parts = rows.mapInPandas(linalg.partial_factors([*columns, "block"], terms, COL_DELTA_B), f"{ddl}, n bigint, sums array<double>, r array<double>")

    parts = tree_reduced(parts, [*columns, "block"], len(terms) + 1)

    def finish(key, pdf: pd.DataFrame) -> pd.DataFrame:
        blocks = {int(b): linalg.Part.merged(linalg.read_parts(g, len(terms) + 1)) for b, g in pdf.groupby("block")}
        model = solve(blocks, config)
        return pd.DataFrame([dict(zip(keys, key)) | model])

    out = ", ".join([*(f"{k} {types[c]}" for k, c in zip(keys, columns)), MODEL])
    if not columns:
        return parts.groupBy(F.lit("all").alias("_all")).applyInPandas(lambda key, pdf: finish((), pdf), out)
    return parts.groupBy(*columns).applyInPandas(finish, out)


def _result(row, rows: DataFrame | None, config: PipelineConfig) -> CalibrationResult:
    w = np.array(row["coefficients"], float)
    residuals = None
    if rows is not None:
        modelled = dot(w, TERMS[config.model_terms])
        residuals = rows.select(FLIGHT, "seg_ord", ROW, "seg_maneuver", "seg_heading", COL_DELTA_B, (modelled - F.col(COL_DELTA_B)).alias("residual"))
    return CalibrationResult(w, residuals, float(row["condition_number"]), np.array(row["singular_values"], float), len(w), row["selected_alpha"], row["effective_dof"], int(row["n"]))


def _check(df: DataFrame, segments: DataFrame, config: PipelineConfig) -> DataFrame:
    if COL_DELTA_B not in df.columns:
        raise ValueError(f"column {COL_DELTA_B!r} is required")
    df = with_keys(df)
    check_segments(df, segments, 2 if needs_neighbours(config) else 1)
    return df


def _warn(result: CalibrationResult, config: PipelineConfig) -> None:
    if config.model_terms in "cd" and result.n_samples < FEW_SAMPLES:
        warnings.warn(f"{result.n_samples} samples for model {config.model_terms!r}; at least {FEW_SAMPLES:,} are recommended.", UserWarning, stacklevel=3)
    if result.condition_number > config.condition_number_threshold:
        warnings.warn(f"The design matrix is ill-conditioned: condition number {result.condition_number:.3e} exceeds {config.condition_number_threshold:.3e}.", UserWarning, stacklevel=3)


def calibrate(df: DataFrame, segments: DataFrame, config: PipelineConfig) -> CalibrationResult:
    """Fit all segment rows together.  Repeated and overlapping segments count
    as often as they are listed."""
    rows = stacked(_check(df, segments, config), segments, config)
    result = _result(fit_models(df, segments, config, [], rows).first(), rows, config)
    _warn(result, config)
    return result


def calibrate_per_heading(df: DataFrame, segments: DataFrame, config: PipelineConfig) -> HeadingCalibrationResult:
    """One fit per heading present, from one pass, with inflation factors, and
    the reference heading of the segment rows."""
    rows = stacked(_check(df, segments, config), segments, config)
    models = {r["heading"]: r for r in fit_models(df, segments, config, ["heading"], rows).collect()}
    per = {h: _result(r, rows.where(F.col("seg_heading") == h), config) for h, r in models.items()}
    for result in per.values():
        _warn(result, config)
    if config.reference_heading_deg is not None:
        reference = float(config.reference_heading_deg)
    elif COL_HEADING in df.columns:
        reference = float(folded_mean(rows, ()).first()["reference_deg"])
    else:
        warnings.warn("no heading column and no reference_heading_deg; the reference heading is taken as 0.", UserWarning, stacklevel=2)
        reference = 0.0
    return HeadingCalibrationResult(per, {h: np.array(r["vif"], float) for h, r in models.items()}, reference)


def calibrate_adaptive_maneuvers(df: DataFrame, segments: DataFrame, config: PipelineConfig) -> AdaptiveCalibrationResult:
    """One fit per maneuver, from one pass; all four maneuvers must be present."""
    rows = stacked(_check(df, segments, config), segments, config)
    models = {r["maneuver"]: r for r in fit_models(df, segments, config, ["maneuver"], rows).collect()}
    missing = [m for m in MANEUVERS if m not in models]
    if missing:
        raise ValueError(f"No segments found for {missing}; all of {list(MANEUVERS)} are needed")
    per = {m: _result(r, rows.where(F.col("seg_maneuver") == m), config) for m, r in models.items()}
    for m, result in per.items():
        if result.condition_number > config.condition_number_threshold:
            use = "the baseline is always used" if m == "steady" else "its weight will be suppressed"
            warnings.warn(f"Adaptive calibration: the '{m}' fit is ill-conditioned (condition number {result.condition_number:.3e}); {use}.", UserWarning, stacklevel=2)
    return AdaptiveCalibrationResult(per["pitch"], per["roll"], per["yaw"], per["steady"], per["pitch"].n_terms)
