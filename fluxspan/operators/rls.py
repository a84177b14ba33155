"""Recursive least squares: single updates, whole recordings in closed form."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fluxspan.config import PipelineConfig
from fluxspan.functions.ordered import flight_ends, join_flights, with_keys
from fluxspan.operators import linalg
from fluxspan.operators.calibrate import CalibrationResult, tree_reduced
from fluxspan.operators.features import add_features, dot
from fluxspan.schema import COL_DELTA_B, FLIGHT, ROW, TERMS


@dataclass(frozen=True)
class RLSState:
    theta: np.ndarray
    covariance: np.ndarray
    forgetting_factor: float
    n_samples: int
    n_terms: int


def _check(forgetting_factor: float, scale: float) -> None:
    if not 0 < forgetting_factor <= 1:
        raise ValueError("forgetting_factor must lie in (0, 1]")
    if not scale > 0:
        raise ValueError("initial_covariance_scale must be positive")


def initialize_rls(result: CalibrationResult, forgetting_factor: float = 1.0, *, initial_covariance_scale: float = 1.0) -> RLSState:
    _check(forgetting_factor, initial_covariance_scale)
    k = result.n_terms
    return RLSState(np.array(result.coefficients, float), initial_covariance_scale * np.eye(k), float(forgetting_factor), 0, k)


def update_rls(state: RLSState, a: np.ndarray, y: float) -> RLSState:
    """One observation.  The state isn't changed; a new one is returned."""
    a = np.asarray(a, float)
    if a.shape != (state.n_terms,):
        raise ValueError(f"expected {state.n_terms} terms, got shape {a.shape}")
    pa = state.covariance @ a
    gain = pa / (state.forgetting_factor + a @ pa)
    theta = state.theta + gain * (y - a @ state.theta)
    p = (state.covariance - np.outer(gain, pa)) / state.forgetting_factor
    return RLSState(theta, (p + p.T) / 2, state.forgetting_factor, state.n_samples + 1, state.n_terms)


def _weighted(featured: DataFrame, config: PipelineConfig, lam: float) -> DataFrame:
    """Terms and target scaled by the root of each row's final weight."""
    terms = [*TERMS[config.model_terms], COL_DELTA_B]
    if lam == 1:
        return featured.select(FLIGHT, *terms)
    ends = flight_ends(featured).withColumn("_end", F.col("_last"))
    root = F.pow(F.lit(lam), (F.col("_end") - F.col(ROW)) / 2)
    return join_flights(featured, ends).select(FLIGHT, *[(F.col(t) * root).alias(t) for t in terms])


def absorb(part: linalg.Part, theta: np.ndarray, covariance: np.ndarray, lam: float) -> tuple[np.ndarray, np.ndarray]:
    """State after all rows of ``part`` (already weighted), exactly what the row
    by row recursion would reach: the prior enters as k further rows."""
    root = np.linalg.cholesky(np.linalg.inv(covariance)).T * lam ** (part.n / 2)
    r = linalg.reduce_rows(np.vstack([np.c_[root, root @ theta], part.r]))
    a = r[:, :-1]
    inverse = np.linalg.inv(a.T @ a)
    return np.linalg.lstsq(a, r[:, -1], rcond=None)[0], (inverse + inverse.T) / 2


def update_rls_by_flight(df: DataFrame, config: PipelineConfig, theta: np.ndarray, covariance: np.ndarray, forgetting_factor: float = 1.0) -> DataFrame:
    """flight_id, n_samples, theta, covariance (row-wise) after all rows of each
    flight, starting from the same prior.  Rows are reduced where they are."""
    if COL_DELTA_B not in df.columns:
        raise ValueError(f"column {COL_DELTA_B!r} is required")
    terms = list(TERMS[config.model_terms])
    rows = _weighted(add_features(with_keys(df), config), config, forgetting_factor)
    kind = rows.schema[FLIGHT].dataType.simpleString()
    parts = rows.mapInPandas(linalg.partial_factors([FLIGHT], terms, COL_DELTA_B), f"{FLIGHT} {kind}, n bigint, sums array<double>, r array<double>")

    parts = tree_reduced(parts, [FLIGHT], len(terms) + 1)

    def finish(key, pdf: pd.DataFrame) -> pd.DataFrame:
        part = linalg.Part.merged(linalg.read_parts(pdf, len(terms) + 1))
        new, p = absorb(part, theta, covariance, forgetting_factor)
        return pd.DataFrame([{FLIGHT: key[0], "n_samples": part.n, "theta": new.tolist(), "covariance": p.ravel().tolist()}])

    return parts.groupBy(FLIGHT).applyInPandas(finish, f"{FLIGHT} {kind}, n_samples bigint, theta array<double>, covariance array<double>")


def update_rls_batch(state: RLSState, df: DataFrame, config: PipelineConfig) -> RLSState:
    """State after all rows of one recording."""
    if len(TERMS[config.model_terms]) != state.n_terms:
        raise ValueError(f"the state has {state.n_terms} terms, model {config.model_terms!r} has {len(TERMS[config.model_terms])}")
    rows = update_rls_by_flight(df, config, state.theta, state.covariance, state.forgetting_factor).take(2)
    if len(rows) > 1:
        raise ValueError("update_rls_batch takes one recording; use update_rls_by_flight for several")
    if not rows:
        return state
    k = state.n_terms
    return RLSState(np.array(rows[0]["theta"]), np.array(rows[0]["covariance"]).reshape(k, k), state.forgetting_factor, state.n_samples + rows[0]["n_samples"], k)


def rls_to_calibration_result(state: RLSState, df: DataFrame, config: PipelineConfig) -> CalibrationResult:
    """Residuals, singular values and condition of ``df`` under the state's coefficients."""
    if COL_DELTA_B not in df.columns:
        raise ValueError(f"column {COL_DELTA_B!r} is required")
    terms = list(TERMS[config.model_terms])
    featured = add_features(with_keys(df), config)
    residuals = featured.select(FLIGHT, ROW, COL_DELTA_B, (dot(state.theta, terms) - F.col(COL_DELTA_B)).alias("residual"))
    parts = featured.select(*terms, COL_DELTA_B).mapInPandas(linalg.partial_factors([], terms, COL_DELTA_B), "n bigint, sums array<double>, r array<double>")
    # at most one small factor per branch of the reduction is read
    merged = tree_reduced(parts, [], len(terms) + 1).toPandas()
    part = linalg.Part.merged(linalg.read_parts(merged, len(terms) + 1))
    sigma = np.linalg.svd(part.a, compute_uv=False)[: min(part.n, part.k)]
    condition = float(sigma[0] / sigma[-1]) if sigma[-1] > 0 else float("inf")
    return CalibrationResult(state.theta.copy(), residuals, condition, sigma, state.n_terms, None, None, part.n)


def rls_residuals_by_flight(states: DataFrame, df: DataFrame, config: PipelineConfig) -> DataFrame:
    """flight_id, row_idx, delta_B and residual of every row under the
    coefficients of its own flight (``states``: as from update_rls_by_flight)."""
    if COL_DELTA_B not in df.columns:
        raise ValueError(f"column {COL_DELTA_B!r} is required")
    keyed = with_keys(df)
    own = flight_ends(keyed).join(states.select(FLIGHT, F.col("theta").alias("_theta")), FLIGHT)
    fitted = sum((F.col("_theta")[i] * F.col(t) for i, t in enumerate(TERMS[config.model_terms])), F.lit(0.0))
    return join_flights(add_features(keyed, config), own).select(FLIGHT, ROW, COL_DELTA_B, (fitted - F.col(COL_DELTA_B)).alias("residual"))
