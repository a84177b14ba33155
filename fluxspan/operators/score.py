"""Compensation: subtracting modelled interference from whole recordings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fluxspan.config import PipelineConfig
from fluxspan.functions.ordered import flight_ends, join_flights, with_keys, with_neighbours
from fluxspan.operators.calibrate import AdaptiveCalibrationResult, CalibrationResult, HeadingCalibrationResult
from fluxspan.operators.features import add_features, dot, with_cosines
from fluxspan.operators.segments import assign_heading_bin, bin_centres_from_ref
from fluxspan.schema import COL_BTOTAL, COL_HEADING, COL_TMI_COMPENSATED, COSINES, FLIGHT, N_TERMS, TERMS


def _check(n_terms: int, config: PipelineConfig) -> list[str]:
    terms = list(TERMS[config.model_terms])
    if n_terms != len(terms):
        raise ValueError(f"the result has {n_terms} coefficients, model {config.model_terms!r} has {N_TERMS[config.model_terms]} terms")
    return terms


def _finish(featured: DataFrame, interference, columns: list[str]) -> DataFrame:
    return featured.withColumn(COL_TMI_COMPENSATED, F.col(COL_BTOTAL) - interference).select(*columns, COL_TMI_COMPENSATED)


def _columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c != COL_TMI_COMPENSATED]


def compensate(df: DataFrame, result: CalibrationResult, config: PipelineConfig) -> DataFrame:
    """All rows and columns of ``df`` and ``tmi_compensated``.  Derivatives run
    over whole recordings; coefficients are literals, so nothing is joined."""
    terms = _check(result.n_terms, config)
    keyed = with_keys(df)
    return _finish(add_features(keyed, config), dot(result.coefficients, terms), _columns(keyed))


def compensate_heading_specific(df: DataFrame, result: HeadingCalibrationResult, config: PipelineConfig) -> DataFrame:
    """Each row gets the model of the nearest calibrated heading, about the
    reference heading of the calibration; a row without heading keeps its field."""
    if COL_HEADING not in df.columns:
        raise ValueError(f"column {COL_HEADING!r} is required")
    keyed = with_keys(df)
    centres = {h: F.lit(c) for h, c in bin_centres_from_ref(result.reference_heading_deg).items() if h in result.per_heading}
    interference = F.lit(0.0)
    for h, model in result.per_heading.items():
        interference = F.when(F.col("_bin") == h, dot(model.coefficients, _check(model.n_terms, config))).otherwise(interference)
    routed = add_features(keyed, config).withColumn("_bin", assign_heading_bin(F.col(COL_HEADING), centres, 180.0))
    return _finish(routed, interference, _columns(keyed))


def rolling_variance(df: DataFrame, columns: dict[str, str], window: int) -> DataFrame:
    """Adds the causal population variance of each column over ``window`` rows:
    {source: new name}."""
    if window < 1:
        raise ValueError("window must be at least 1")

    def build(x, w):
        frame = w.rowsBetween(-(window - 1), 0)
        return x.withColumns({out: F.var_pop(c).over(frame) for c, out in columns.items()})

    return with_neighbours(df, [FLIGHT], window - 1, 0, build)


def blend_weights(df: DataFrame, config: PipelineConfig, suppressed: tuple[bool, bool, bool] = (False, False, False)) -> DataFrame:
    """Adds w_pitch, w_roll, w_yaw and w_steady, which sum to one: variances of
    the cosines against a constant for steady flight."""
    varied = rolling_variance(df, dict(zip(COSINES, ("_vx", "_vy", "_vz"))), config.maneuver_detection_window)
    parts = [F.lit(0.0) if off else F.col(v) for off, v in zip(suppressed, ("_vx", "_vy", "_vz"))]
    total = sum(parts, F.lit(0.0)) + F.lit(float(config.maneuver_baseline_weight))
    shares = dict(zip(("w_pitch", "w_roll", "w_yaw"), (p / total for p in parts)))
    return varied.withColumns(shares | {"w_steady": F.lit(float(config.maneuver_baseline_weight)) / total}).drop("_vx", "_vy", "_vz")


def compensate_adaptive(df: DataFrame, result: AdaptiveCalibrationResult, config: PipelineConfig) -> DataFrame:
    """Blend of the maneuver fits by recent variance; ill-conditioned pitch, roll
    and yaw fits get no weight, the steady fit always keeps its own."""
    terms = _check(result.n_terms, config)
    keyed = with_keys(df)
    off = tuple(m.condition_number > config.condition_number_threshold for m in (result.pitch, result.roll, result.yaw))
    blended = blend_weights(add_features(keyed, config), config, off)
    models = {"w_pitch": result.pitch, "w_roll": result.roll, "w_yaw": result.yaw, "w_steady": result.baseline}
    interference = sum((F.col(w) * dot(m.coefficients, terms) for w, m in models.items()), F.lit(0.0))
    return _finish(blended, interference, _columns(keyed))


def compensate_by_model(df: DataFrame, models: DataFrame, config: PipelineConfig) -> DataFrame:
    """Compensate every flight with its own row of a model table keyed by
    flight_id (flights without a model keep null)."""
    terms = TERMS[config.model_terms]
    keyed = with_keys(df)
    placed = flight_ends(keyed).join(models.select(FLIGHT, "coefficients"), FLIGHT)
    joined = join_flights(add_features(keyed, config), placed, "left")
    interference = sum((F.col("coefficients")[i] * F.col(t) for i, t in enumerate(terms)), F.lit(0.0))
    return _finish(joined, interference, _columns(keyed))


def cosine_frame(df: DataFrame) -> DataFrame:
    """Keyed rows with direction cosines, the input of the two functions above."""
    return with_cosines(with_keys(df))

