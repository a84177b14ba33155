"""Structured Streaming: online recursive least squares and live compensation."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from fluxspan.config import PipelineConfig
from fluxspan.operators.calibrate import CalibrationResult
from fluxspan.operators.features import dot, product_terms, with_cosines, with_rates
from fluxspan.schema import COL_BTOTAL, COL_BX, COL_BY, COL_BZ, COL_DELTA_B, COL_TIME, COL_TMI_COMPENSATED, FLIGHT, IMU_COLUMNS, ROW, TERMS


def compensate_stream(stream: DataFrame, result: CalibrationResult, config: PipelineConfig) -> DataFrame:
    """Row-wise compensation of a stream, without state: models a and b, and c
    and d with measured rates."""
    if config.model_terms in "cd" and not config.use_imu_rates:
        raise ValueError("a stateless stream needs measured rates for models c and d (use_imu_rates)")
    featured = with_cosines(stream)
    if config.model_terms in "cd":
        featured = with_rates(featured, config, None)
    featured = featured.withColumns(terms) if (terms := product_terms(config)) else featured
    keep = [c for c in stream.columns if c != COL_TMI_COMPENSATED]
    return featured.withColumn(COL_TMI_COMPENSATED, F.col(COL_BTOTAL) - dot(result.coefficients, TERMS[config.model_terms])).select(*keep, COL_TMI_COMPENSATED)


def term_rows(b: np.ndarray, time: np.ndarray, rates: np.ndarray | None, last: tuple[np.ndarray, float] | None, model: str) -> np.ndarray:
    """Terms of successive rows with causal rates; ``last`` holds cosines and
    time of the row before them."""
    cos = b / np.linalg.norm(b, axis=1, keepdims=True)
    out = [cos]
    if model in "bcd":
        out.append(np.stack([cos[:, i] * cos[:, j] for i in range(3) for j in range(i, 3)], 1))
    if model in "cd":
        if rates is None:
            c0, t0 = last if last is not None else (cos[:1], np.nan)
            step = np.diff(np.r_[t0, time])
            rates = np.diff(np.vstack([np.reshape(c0, (1, 3)), cos]), axis=0) / step[:, None]
        out.append(np.stack([cos[:, i] * rates[:, j] for i in range(3) for j in range(3)], 1))
        if model == "d":
            out.append(rates)
    return np.hstack(out)


def rls_stream(stream: DataFrame, config: PipelineConfig, theta: np.ndarray, covariance: np.ndarray, forgetting_factor: float = 1.0) -> DataFrame:
    """Online coefficients of every flight: flight_id, n_samples, theta after
    each micro-batch.

    Rows of a batch are taken in order of ``row_idx``.  The recursion depends on
    order, so rows at or before the last position already used are late and are
    left out.  With causal rates the first row of a flight only opens the state.
    """
    k = len(TERMS[config.model_terms])
    rates = list(IMU_COLUMNS) if config.model_terms in "cd" and config.use_imu_rates else []
    causal = config.model_terms in "cd" and not rates
    kind = stream.schema[FLIGHT].dataType.simpleString()
    state_ddl = "theta array<double>, covariance array<double>, n bigint, last_row bigint, cosines array<double>, time double"

    def advance(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.exists:
            th, p, n, last_row, cosines, time = state.get
            th, p, last = np.array(th), np.array(p).reshape(k, k), (np.array(cosines), time) if n or len(cosines) else None
        else:
            th, p, n, last_row, last = theta.copy(), covariance.copy(), 0, -1, None
        pdf = pd.concat(list(batches), ignore_index=True).sort_values(ROW, kind="stable").drop_duplicates(ROW)
        pdf = pdf[pdf[ROW] > last_row].dropna(subset=[COL_TIME, COL_BX, COL_BY, COL_BZ, COL_DELTA_B])
        if len(pdf):
            b, t = pdf[[COL_BX, COL_BY, COL_BZ]].to_numpy(float), pdf[COL_TIME].to_numpy(float)
            a = term_rows(b, t, pdf[rates].to_numpy(float) if rates else None, last, config.model_terms)
            y = pdf[COL_DELTA_B].to_numpy(float)
            skip = 1 if causal and last is None else 0
            for row, value in zip(a[skip:], y[skip:]):
                pa = p @ row
                gain = pa / (forgetting_factor + row @ pa)
                th = th + gain * (value - row @ th)
                p = (p - np.outer(gain, pa)) / forgetting_factor
                p = (p + p.T) / 2
            n += len(pdf) - skip
            cos = b[-1] / np.linalg.norm(b[-1])
            state.update((th.tolist(), p.ravel().tolist(), int(n), int(pdf[ROW].iloc[-1]), cos.tolist(), float(t[-1])))
        yield pd.DataFrame([{FLIGHT: key[0], "n_samples": int(n), "theta": th.tolist()}])

    needed = [FLIGHT, ROW, COL_TIME, COL_BX, COL_BY, COL_BZ, COL_DELTA_B, *rates]
    return stream.select(*needed).groupBy(FLIGHT).applyInPandasWithState(advance, f"{FLIGHT} {kind}, n_samples bigint, theta array<double>", state_ddl, "update", GroupStateTimeout.NoTimeout)
