"""Design matrix of the linear interference model, as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fluxspan.config import PipelineConfig
from fluxspan.functions.ordered import backward_difference, gradient, with_keys, with_neighbours
from fluxspan.schema import COL_BX, COL_BY, COL_BZ, COL_PITCH_RATE, COL_ROLL_RATE, COL_TIME, COL_YAW_RATE, COSINES, EDDY, FLIGHT, INDUCED, RATES, ROW, TERMS


def with_cosines(df: DataFrame) -> DataFrame:
    """Direction cosines of the fluxgate vector; a zero vector raises."""
    size = F.sqrt(F.col(COL_BX) * F.col(COL_BX) + F.col(COL_BY) * F.col(COL_BY) + F.col(COL_BZ) * F.col(COL_BZ))
    sized = df.withColumn("_size", F.when(size <= 0, F.raise_error(F.lit("fluxgate magnitude must be positive")).cast("double")).otherwise(size))
    return sized.withColumns({c: F.col(b) / F.col("_size") for c, b in zip(COSINES, (COL_BX, COL_BY, COL_BZ))}).drop("_size")


def needs_neighbours(config: PipelineConfig) -> bool:
    return config.model_terms in "cd" and not config.use_imu_rates


def with_rates(df: DataFrame, config: PipelineConfig, window) -> DataFrame:
    """Rates of the cosines: measured rates, backward differences under
    cross-validation, central differences otherwise."""
    if config.use_imu_rates:
        missing = [c for c in (COL_ROLL_RATE, COL_PITCH_RATE, COL_YAW_RATE) if c not in df.columns]
        if missing:
            raise ValueError(f"use_imu_rates needs the columns {missing}")
        return df.withColumns({r: F.col(c) for r, c in zip(RATES, (COL_ROLL_RATE, COL_PITCH_RATE, COL_YAW_RATE))})
    rate = backward_difference if config.use_cv else gradient
    return df.withColumns({r: rate(F.col(c), F.col(COL_TIME), window) for r, c in zip(RATES, COSINES)})


def product_terms(config: PipelineConfig) -> dict[str, Column]:
    """Products of cosines and of cosines with rates, by term name."""
    terms = {}
    if config.model_terms in "bcd":
        pairs = [(i, j) for i in range(3) for j in range(i, 3)]
        terms |= {n: F.col(COSINES[i]) * F.col(COSINES[j]) for n, (i, j) in zip(INDUCED, pairs)}
    if config.model_terms in "cd":
        terms |= {n: F.col(COSINES[k // 3]) * F.col(RATES[k % 3]) for k, n in enumerate(EDDY)}
    return terms


def add_features(df: DataFrame, config: PipelineConfig, keys: Sequence[str] = (FLIGHT,)) -> DataFrame:
    """All columns of ``df`` and the model's terms.

    Derivatives never cross a change of ``keys``: (flight_id,) for whole
    recordings, (flight_id, seg_ord) for calibration segments.
    """
    df = with_cosines(df)
    if config.model_terms in "cd":
        if config.use_imu_rates:
            df = with_rates(df, config, None)
        else:
            df = with_neighbours(df, keys, 2 if config.use_cv else 1, 1, lambda x, w: with_rates(x, config, w))
    return df.withColumns(terms) if (terms := product_terms(config)) else df


def build_feature_matrix(df: DataFrame, config: PipelineConfig) -> DataFrame:
    """flight_id, row_idx and the model's terms in their fixed order, for
    whole recordings.  Models c and d need two rows per recording."""
    df = with_keys(df)
    if needs_neighbours(config) and not df.groupBy(FLIGHT).count().where("count < 2").isEmpty():
        raise ValueError("At least 2 rows are needed for model terms c and d")
    return add_features(df, config).select(FLIGHT, ROW, *TERMS[config.model_terms])


def dot(coefficients: Sequence[float], terms: Sequence[str]) -> Column:
    """Modelled interference with literal coefficients."""
    return sum((F.lit(float(c)) * F.col(t) for c, t in zip(coefficients, terms)), F.lit(0.0))
