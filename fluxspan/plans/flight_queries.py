"""Queries over a deterministic calibration flight per 800 events, one or more
per operator.  ``FLIGHT`` is the fixture; its functions are spelt alike in both
engines."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from fluxspan.config import PipelineConfig
from fluxspan.operators import linalg, nn, rls
from fluxspan.operators.baseline import compute_interference, model_baseline
from fluxspan.operators.calibrate import calibrate, calibrate_adaptive_maneuvers, calibrate_per_heading, fit_models, stacked, tree_reduced
from fluxspan.operators.features import add_features, build_feature_matrix, with_cosines
from fluxspan.operators.fom import fom_table
from fluxspan.operators.score import blend_weights, compensate, compensate_adaptive, compensate_by_model, compensate_heading_specific, cosine_frame, rolling_variance
from fluxspan.operators.segments import attitude_rates, auto_segments, centre_columns, explicit_segments, folded_mean, rows_in_segments, steady_rows, unwrapped_heading
from fluxspan.operators.validate import validation_counts
from fluxspan.schema import COSINES, FLIGHT as KEY, ROW, TERMS
from fluxspan.shared import checkpointed

FLIGHT = """
SELECT flight_id, row_idx, time, lat, lon, alt,
  44721.0 + (50 * B_x - 30 * B_y + 20 * B_z) / sqrt(B_x * B_x + B_y * B_y + B_z * B_z) + 0.001 * value AS B_total,
  B_x, B_y, B_z, heading, pitch, roll, segment, radians(roll) AS roll_rate, radians(pitch) AS pitch_rate, 0.001 * value AS yaw_rate
FROM (SELECT *, u * cos(radians(pitch)) - 20000 * sin(radians(pitch)) AS B_x, v * cos(radians(roll)) + zz * sin(radians(roll)) AS B_y, -v * sin(radians(roll)) + zz * cos(radians(roll)) AS B_z
FROM (SELECT *, u * sin(radians(pitch)) + 20000 * cos(radians(pitch)) AS zz
FROM (SELECT *, 40000 * cos(radians(heading)) AS u, -40000 * sin(radians(heading)) AS v
FROM (SELECT flight_id, row_idx, value, 0.1 * row_idx + 0.00001 * value AS time, cast(45.0 AS double) AS lat, cast(-75.0 AS double) AS lon, cast(0.3 AS double) AS alt,
  CASE WHEN mv = 1 THEN 10 * sin(ph) ELSE cast(0.0 AS double) END AS pitch, CASE WHEN mv = 2 THEN 10 * sin(ph) ELSE cast(0.0 AS double) END AS roll,
  cast(2.0 AS double) + 90 * hq + CASE WHEN mv = 3 THEN 5 * sin(ph) ELSE cast(0.0 AS double) END AS heading,
  concat(CASE mv WHEN 0 THEN 'steady' WHEN 1 THEN 'pitch' WHEN 2 THEN 'roll' ELSE 'yaw' END, '_', CASE hq WHEN 0 THEN 'N' WHEN 1 THEN 'E' WHEN 2 THEN 'S' ELSE 'W' END) AS segment
FROM (SELECT *, cast(floor(blk / 4.0) AS int) AS hq, blk % 4 AS mv, 2 * pi() * j / 50.0 AS ph
FROM (SELECT *, cast(floor(row_idx / 50.0) AS int) AS blk, row_idx % 50 AS j
FROM (SELECT cast(floor(event_id / 800.0) AS int) AS flight_id, cast(event_id % 800 AS int) AS row_idx, cast(value AS double) AS value FROM events) q1) q2) q3) q4) q5) q6) q7
"""


def flight(spark, d):
    return spark.sql(FLIGHT.replace("FROM events", f"FROM parquet.`{d}/events.parquet`"))


A, B, C, D = (PipelineConfig(model_terms=m, earth_field_method="steady_mean", segment_label_col="segment", use_imu_rates=False) for m in "abcd")
CAUSAL = C.replace(use_cv=True)
IMU = D.replace(use_imu_rates=True)


def _long(df, terms, digits=6):
    """One row per term: narrow results compare term by term."""
    pairs = F.array(*[F.struct(F.lit(t).alias("term"), (F.round(F.col(t), digits) + 0.0).alias("value")) for t in terms])
    return df.select(KEY, ROW, F.explode(pairs).alias("p")).select(KEY, ROW, "p.term", "p.value")


def _rounded(df, *columns, digits=6):
    return df.withColumns({c: F.round(F.col(c), digits) + 0.0 for c in columns})


def _delta(spark, d):
    df = flight(spark, d)
    # a row per some fifty readings, used several times over: written once
    segments = checkpointed(explicit_segments(df, "segment"))
    return compute_interference(steady_rows(df, segments), A, "steady"), segments


# -- validation, features ----------------------------------------------------
def validate_counts(spark, d):
    return validation_counts(flight(spark, d))


def direction_cosines(spark, d):
    return _long(with_cosines(flight(spark, d)), COSINES)


def features_b(spark, d):
    return _long(build_feature_matrix(flight(spark, d), B), TERMS["b"])


def features_c_central(spark, d):
    return _long(build_feature_matrix(flight(spark, d), C), TERMS["c"])


def features_c_causal(spark, d):
    return _long(build_feature_matrix(flight(spark, d), CAUSAL), TERMS["c"])


def features_d(spark, d):
    return _long(build_feature_matrix(flight(spark, d), D), TERMS["d"])


def features_imu(spark, d):
    return _long(build_feature_matrix(flight(spark, d), IMU), TERMS["d"])


def features_c_in_segments(spark, d):
    df = flight(spark, d)
    rows = add_features(rows_in_segments(df, explicit_segments(df, "segment")), C, (KEY, "seg_ord"))
    return _long(rows, TERMS["c"])


# -- segmentation ------------------------------------------------------------
def heading_ref(spark, d):
    ref = folded_mean(flight(spark, d))
    out = ref.select(KEY, "reference_deg", *[c.alias(f"centre_{h}") for h, c in centre_columns(F.col("reference_deg")).items()])
    return _rounded(out, "reference_deg", *[f"centre_{h}" for h in "NESW"])


def heading_bin(spark, d):
    return attitude_rates(flight(spark, d), A).select(KEY, ROW, "bin")


def attitude_rate_rows(spark, d):
    rates = ("pitch_deg_s", "roll_deg_s", "yaw_deg_s")
    return _rounded(attitude_rates(flight(spark, d), A).select(KEY, ROW, *rates), *rates)


def yaw_unwrap(spark, d):
    return _rounded(unwrapped_heading(flight(spark, d)).select(KEY, ROW, "heading_unwrapped"), "heading_unwrapped")


def maneuver_label(spark, d):
    return attitude_rates(flight(spark, d), A).select(KEY, ROW, "maneuver")


def segments_explicit(spark, d):
    return explicit_segments(flight(spark, d), "segment")


def segments_auto(spark, d):
    return auto_segments(flight(spark, d), A.replace(segment_label_col=None))


def steady_mask(spark, d):
    df = flight(spark, d)
    return steady_rows(df, explicit_segments(df, "segment")).select(KEY, ROW, "steady")


# -- baseline ----------------------------------------------------------------
def delta_b_steady(spark, d):
    return _rounded(_delta(spark, d)[0].select(KEY, ROW, "delta_B"), "delta_B")


def delta_b_all(spark, d):
    return _rounded(compute_interference(flight(spark, d), A).select(KEY, ROW, "delta_B"), "delta_B")


# rounded numbers of the size of the Earth's dipole, to compare with its closed form
DIPOLE = {(1, 0): -29400.0, (1, 1): -1450.0, (1, -1): 4650.0}


def model_field(spark, d):
    """Main-field strength along tracks that cross latitudes and longitudes."""
    track = flight(spark, d).withColumns({"lat": F.col("lat") - F.col(KEY) % 100 + 0.01 * F.col(ROW), "lon": F.col("lon") + 0.02 * F.col(ROW)})
    return _rounded(model_baseline(track, DIPOLE).select(KEY, ROW, "baseline"), "baseline", digits=4)


# -- calibration -------------------------------------------------------------
def _gram(spark, d, config, keys):
    df, segments = _delta(spark, d)
    names = {"heading": "seg_heading", "maneuver": "seg_maneuver"}
    columns, terms = [names[k] for k in keys], list(TERMS[config.model_terms])
    rows = stacked(df, segments, config).select(*columns, *terms, "delta_B")
    ddl = "".join(f"{c} string, " for c in columns)
    parts = tree_reduced(rows.mapInPandas(linalg.partial_factors(columns, terms, "delta_B"), ddl + "n bigint, sums array<double>, r array<double>"), columns, len(terms) + 1)
    k = len(terms) + 1

    def gram(key, pdf):
        r = linalg.Part.merged(linalg.read_parts(pdf, k)).r
        g = r.T @ r
        return pd.DataFrame([dict(zip(keys, key)) | {"i": i, "j": j, "value": g[i, j]} for i in range(k) for j in range(i, k)])

    out = "".join(f"{c} string, " for c in keys) + "i int, j int, value double"
    grouped = parts.groupBy(*(columns or [F.lit("all").alias("_all")]))
    return _rounded(grouped.applyInPandas((lambda key, pdf: gram(key, pdf)) if columns else (lambda key, pdf: gram((), pdf)), out), "value", digits=4)


def gram_b(spark, d):
    return _gram(spark, d, B, [])


def gram_c(spark, d):
    return _gram(spark, d, C, [])


def gram_by_heading(spark, d):
    return _gram(spark, d, A, ["heading"])


def gram_by_maneuver(spark, d):
    return _gram(spark, d, A, ["maneuver"])


def _coefficients(models, keys):
    out = models.select(*keys, "n", F.posexplode("coefficients").alias("i", "value"))
    return _rounded(out.withColumn("i", F.col("i").cast("int")), "value")


def _fit(spark, d, config, keys=()):
    df, segments = _delta(spark, d)
    return fit_models(df, segments, config, list(keys))


def ols_a(spark, d):
    return _coefficients(_fit(spark, d, A), [])


def ridge_a(spark, d):
    return _coefficients(_fit(spark, d, A.replace(use_ridge=True, ridge_alpha=25.0)), [])


def ols_a_by_flight(spark, d):
    return _coefficients(_fit(spark, d, A, [KEY]), [KEY])


def ols_a_by_heading(spark, d):
    return _coefficients(_fit(spark, d, A, ["heading"]), ["heading"])


def ols_a_by_maneuver(spark, d):
    return _coefficients(_fit(spark, d, A, ["maneuver"]), ["maneuver"])


def vif_a(spark, d):
    return _rounded(_fit(spark, d, A, ["heading"]).select("heading", F.posexplode("vif").alias("i", "vif")).withColumn("i", F.col("i").cast("int")), "vif", digits=5)


def condition_a(spark, d):
    """Singular values and condition number of the pooled design matrix."""
    model = _fit(spark, d, A).select("condition_number", F.posexplode("singular_values").alias("i", "singular_value"))
    return _rounded(model.withColumn("i", F.col("i").cast("int")), "condition_number", "singular_value", digits=5)


_LASSO = 40_000.0


def lasso_a(spark, d):
    return _coefficients(_fit(spark, d, A.replace(use_lasso=True, lasso_alpha=_LASSO)), [])


def elastic_net_a(spark, d):
    return _coefficients(_fit(spark, d, A.replace(use_elastic_net=True, elastic_net_alpha=_LASSO, elastic_net_l1_ratio=0.5)), [])


def effective_dof_a(spark, d):
    """Effective degrees of freedom under each penalty."""
    df, segments = _delta(spark, d)
    fits = {"ridge": A.replace(use_ridge=True, ridge_alpha=_LASSO), "lasso": A.replace(use_lasso=True, lasso_alpha=_LASSO), "elastic_net": A.replace(use_elastic_net=True, elastic_net_alpha=_LASSO, elastic_net_l1_ratio=0.5)}
    parts = [fit_models(df, segments, c, []).select(F.lit(m).alias("method"), "selected_alpha", "effective_dof") for m, c in fits.items()]
    return _rounded(parts[0].unionByName(parts[1]).unionByName(parts[2]), "effective_dof")


def ridge_cv_a(spark, d):
    model = _fit(spark, d, A.replace(use_ridge=True, use_cv=True))
    return _rounded(model.select("n", F.col("selected_alpha"), F.posexplode("coefficients").alias("i", "value")).withColumn("i", F.col("i").cast("int")), "value", "selected_alpha", digits=5)


def lasso_cv_a(spark, d):
    return _coefficients(_fit(spark, d, A.replace(use_lasso=True, use_cv=True)), [])


def elastic_net_cv_a(spark, d):
    return _coefficients(_fit(spark, d, A.replace(use_elastic_net=True, use_cv=True)), [])


def auto_ridge_c(spark, d):
    """Model c, whose condition exceeds the lowered threshold, falls back to ridge."""
    model = _fit(spark, d, C.replace(auto_regularize=True, condition_number_threshold=10.0))
    return model.select("n", "selected_alpha", F.size("coefficients").alias("n_terms"))


def residuals_a(spark, d):
    df, segments = _delta(spark, d)
    out = calibrate(df, segments, A).residuals
    return _rounded(out.select(KEY, "seg_ord", ROW, "residual"), "residual")


# -- compensation ------------------------------------------------------------
def _tmi(df, digits=6):
    return _rounded(df.select(KEY, ROW, "tmi_compensated"), "tmi_compensated", digits=digits)


def compensate_a(spark, d):
    df, segments = _delta(spark, d)
    return _tmi(compensate(flight(spark, d), calibrate(df, segments, A), A))


def compensate_c(spark, d):
    df, segments = _delta(spark, d)
    return _tmi(compensate(flight(spark, d), calibrate(df, segments, C), C), digits=3)


def compensate_by_flight_a(spark, d):
    return _tmi(compensate_by_model(flight(spark, d), _fit(spark, d, A, [KEY]), A))


def compensate_heading_a(spark, d):
    df, segments = _delta(spark, d)
    return _tmi(compensate_heading_specific(flight(spark, d), calibrate_per_heading(df, segments, A), A))


def compensate_adaptive_a(spark, d):
    df, segments = _delta(spark, d)
    return _tmi(compensate_adaptive(flight(spark, d), calibrate_adaptive_maneuvers(df, segments, A), A))


def rolling_variances(spark, d):
    out = rolling_variance(cosine_frame(flight(spark, d)), dict(zip(COSINES, ("var_x", "var_y", "var_z"))), 50)
    return _rounded(out.select(KEY, ROW, "var_x", "var_y", "var_z"), "var_x", "var_y", "var_z", digits=9)


def blending_weights(spark, d):
    names = ("w_pitch", "w_roll", "w_yaw", "w_steady")
    return _rounded(blend_weights(cosine_frame(flight(spark, d)), A).select(KEY, ROW, *names), *names, digits=8)


# -- report ------------------------------------------------------------------
def _fom(spark, d, keys=()):
    df, segments = _delta(spark, d)
    return fom_table(calibrate(df, segments, A).residuals, tuple(keys))


def fom_by_maneuver(spark, d):
    return _rounded(_fom(spark, d).where("maneuver is not null").select("maneuver", "rms_before", "rms_after", "n_samples"), "rms_before", "rms_after")


def fom_by_heading(spark, d):
    return _rounded(_fom(spark, d).where("heading is not null").select("heading", "rms_before", "rms_after", "n_samples"), "rms_before", "rms_after")


def fom_ratio(spark, d):
    return _rounded(_fom(spark, d).where("maneuver is null and heading is null").select("n_samples", "improvement_ratio"), "improvement_ratio", digits=5)


def fom_by_flight(spark, d):
    """Report of every flight: all groups of each."""
    out = _fom(spark, d, (KEY,)).select(KEY, F.coalesce("maneuver", F.lit("-")).alias("maneuver"), F.coalesce("heading", F.lit("-")).alias("heading"), "rms_before", "rms_after", "n_samples")
    return _rounded(out, "rms_before", "rms_after")


# -- recursive least squares ---------------------------------------------------
def _rls(spark, d, lam, scale):
    df, _ = _delta(spark, d)
    states = rls.update_rls_by_flight(df, A, np.zeros(3), scale * np.eye(3), lam)
    return _rounded(states.select(KEY, "n_samples", F.posexplode("theta").alias("i", "value")).withColumn("i", F.col("i").cast("int")), "value", digits=5)


def rls_a_lambda1(spark, d):
    return _rls(spark, d, 1.0, 100.0)


def rls_a_forget(spark, d):
    return _rls(spark, d, 0.98, 100.0)


def rls_result_a(spark, d):
    """Residual spread of each flight under its own recursively updated coefficients."""
    df, _ = _delta(spark, d)
    residuals = rls.rls_residuals_by_flight(rls.update_rls_by_flight(df, A, np.zeros(3), 1e6 * np.eye(3)), df, A)
    return residuals.groupBy(KEY).agg(F.round(F.stddev_pop("residual"), 4).alias("spread"), F.count("*").alias("n"))


# -- neural --------------------------------------------------------------------
def nn_predict(spark, d):
    df, segments = _delta(spark, d)
    return nn.predict_nn(df, nn.calibrate_nn(df, segments)).select(KEY, ROW, "nn_mean", "nn_std")


def nn_compensate(spark, d):
    df, segments = _delta(spark, d)
    return nn.compensate_nn(df, nn.calibrate_nn(df, segments)).select(KEY, ROW, "tmi_compensated")


def pinn_predict(spark, d):
    df, segments = _delta(spark, d)
    return nn.predict_pinn(df, nn.calibrate_pinn(df, segments, nn.PINNConfig(tl_pipeline_config=B))).select(KEY, ROW, "pinn_mean", "pinn_std")


QUERIES = {
    f.__name__: f
    for f in (
        fom_by_flight, validate_counts, direction_cosines, features_b, features_c_central, features_c_causal, features_d, features_imu, features_c_in_segments,
        heading_ref, heading_bin, attitude_rate_rows, yaw_unwrap, maneuver_label, segments_explicit, segments_auto, steady_mask, delta_b_steady, delta_b_all, model_field,
        gram_b, gram_c, gram_by_heading, gram_by_maneuver, ols_a, ridge_a, ols_a_by_flight, ols_a_by_heading, ols_a_by_maneuver, vif_a, condition_a,
        lasso_a, elastic_net_a, effective_dof_a, ridge_cv_a, lasso_cv_a, elastic_net_cv_a, auto_ridge_c, residuals_a, compensate_a, compensate_c, compensate_by_flight_a,
        compensate_heading_a, compensate_adaptive_a, rolling_variances, blending_weights, fom_by_maneuver, fom_by_heading, fom_ratio,
        rls_a_lambda1, rls_a_forget, rls_result_a, nn_predict, nn_compensate, pinn_predict,
    )
}
