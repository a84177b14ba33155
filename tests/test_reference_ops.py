"""Validation, segmentation, features, calibration, compensation, report, online
updates, ensembles and streams on small recordings, against numpy."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from fluxspan.config import PipelineConfig
from fluxspan.functions.ordered import running_sum
from fluxspan.operators import linalg, nn, rls, segments as seg
from fluxspan.operators.baseline import compute_interference
from fluxspan.operators.calibrate import CalibrationResult, calibrate, calibrate_adaptive_maneuvers, calibrate_per_heading, fit_models, stacked
from fluxspan.operators.features import build_feature_matrix
from fluxspan.operators.fom import compute_fom_report
from fluxspan.operators.score import compensate, compensate_adaptive, compensate_heading_specific, rolling_variance
from fluxspan.operators.validate import validate_dataframe
from fluxspan.schema import N_TERMS, TERMS
from tests.flights import random_directions, segments, synthetic_flight

A = PipelineConfig(model_terms="a")


def valid(n=5):
    i = np.arange(n)
    return pd.DataFrame({"time": 1.0 * i, "lat": 45 + 0.001 * i, "lon": -75.0 + 0 * i, "alt": 0.3 + 0 * i, "B_total": 50000.0 + i, "B_x": 100.0 + i, "B_y": 200.0 + i, "B_z": 300.0 + i})


# -- validation -------------------------------------------------------------
def test_valid_frame_is_returned(spark):
    df = spark.createDataFrame(valid().assign(extra="x"))
    assert validate_dataframe(df) is df
    assert validate_dataframe(spark.createDataFrame(valid(1))).count() == 1


@pytest.mark.parametrize(
    "change, message",
    [
        (lambda p: p.drop(columns="lat"), "Missing"), (lambda p: p.assign(B_x=p.B_x.astype("int64")), "double"),
        (lambda p: p.assign(B_total=-1.0), "positive"), (lambda p: p.assign(time=[0.0, 1, 1, 2, 3]), "increasing"), (lambda p: p.assign(time=[0.0, 1, 0.5, 2, 3]), "increasing"), (lambda p: p.assign(roll_rate=1), "roll_rate"),
    ],
)
def test_refused_frames(spark, change, message):
    with pytest.raises(ValueError, match=message):
        validate_dataframe(spark.createDataFrame(change(valid())))


def test_nulls_empty_nan_and_types(spark):
    df = spark.createDataFrame(valid())
    with pytest.raises(ValueError, match="empty"):
        validate_dataframe(df.limit(0))
    with pytest.raises(ValueError, match="null"):
        validate_dataframe(df.withColumn("B_x", F.when(F.col("B_x") > 102, F.col("B_x"))))
    assert validate_dataframe(df.withColumn("B_total", F.lit(float("nan"))))
    with pytest.raises(TypeError):
        validate_dataframe(valid())
    with pytest.raises(ValueError, match="double"):
        validate_dataframe(df.withColumn("B_x", F.col("B_x").cast("float")))
    with pytest.raises(ValueError) as e:
        validate_dataframe(df.drop("lat").withColumn("time", F.lit(1.0)))
    assert "Missing" in str(e.value) and "increasing" in str(e.value)


# -- segmentation -----------------------------------------------------------
def test_running_sum_over_chunks(spark):
    df = spark.range(100).selectExpr("cast(id % 2 as int) flight_id", "cast(floor(id / 2) as int) row_idx", "1 as v")
    out = running_sum(df, ["flight_id"], "v", "total", size=7).toPandas()
    assert (out.total == out.row_idx + 1).all()


def test_bin_centres():
    assert seg.bin_centres_from_ref(10.0) == {"N": 10.0, "E": 100.0, "S": 190.0, "W": 280.0}
    assert seg.bin_centres_from_ref(47.0) == {"N": 317.0, "E": 47.0, "S": 137.0, "W": 227.0}
    assert seg.bin_centres_from_ref(45.0)["N"] == 45.0  # tie: the first spoke


@pytest.mark.parametrize("heading, tolerance, expected", [(45.0, 45, "N"), (135.0, 45, "E"), (225.0, 45, "S"), (315.0, 45, "N"), (44.0, 10, None), (10.0, 10, "N"), (float("nan"), 45, None), (359.0, 45, "N"), (-1.0, 45, "N")])
def test_heading_bins(spark, heading, tolerance, expected):
    centres = {h: F.lit(c) for h, c in seg.bin_centres_from_ref(0.0).items()}
    row = spark.range(1).select(seg.assign_heading_bin(F.lit(heading), centres, tolerance).alias("b")).first()
    assert row["b"] == expected


@pytest.mark.parametrize("rates, expected", [((0.5, 0.5, 0.9), "steady"), ((2.0, 2.0, 2.0), "pitch"), ((1.0, 2.0, 2.0), "roll"), ((1.0, 1.0, -3.0), "yaw"), ((float("nan"), 1.0, 1.0), None)])
def test_maneuvers(spark, rates, expected):
    assert spark.range(1).select(seg.classify_maneuver(*[F.lit(r) for r in rates]).alias("m")).first()["m"] == expected


def test_explicit_and_automatic_segments(spark):
    df = spark.createDataFrame(synthetic_flight(rows=20))
    explicit = seg.segment_fom(df, PipelineConfig(segment_label_col="segment")).orderBy("seg_ord").collect()
    assert len(explicit) == 16 and all(r.end_idx - r.start_idx == 20 for r in explicit)
    assert (explicit[1].maneuver, explicit[1].heading, explicit[1].start_idx) == ("pitch", "N", 20)
    auto = seg.segment_fom(df, PipelineConfig(reference_heading_deg=0.0)).collect()
    assert {(r.maneuver, r.heading) for r in auto} >= {("yaw", h) for h in "NESW"}


@pytest.mark.parametrize("label", ["hover_N", "pitch_X", "a_b_c", None, "Pitch_N"])
def test_bad_labels(spark, label):
    df = spark.createDataFrame([(0.0, label), (1.0, label)], "time double, segment string")
    with pytest.raises(Exception, match="invalid segment label"):
        seg.explicit_segments(df, "segment").collect()


def test_segment_bounds(spark):
    df = spark.createDataFrame(random_directions(10))
    for bad in ((5, 5), (-1, 3), (0, 11)):
        with pytest.raises(ValueError):
            seg.check_segments(df, segments(spark, ("steady", "N", *bad)))
    with pytest.raises(ValueError):
        seg.check_segments(df, segments(spark, ("steady", "N", 0, 5)).limit(0))


def test_overlapping_segments_count_twice(spark):
    df = spark.createDataFrame(random_directions(20))
    assert seg.rows_in_segments(df, segments(spark, ("steady", "N", 0, 10), ("pitch", "N", 5, 20))).count() == 25


# -- baseline, features -----------------------------------------------------
def test_steady_mean(spark):
    df = spark.createDataFrame(valid().assign(flag=[True, True, False, False, False]))
    config = PipelineConfig(earth_field_method="steady_mean")
    assert [r.delta_B for r in compute_interference(df, config, "flag").orderBy("time").collect()] == [-0.5, 0.5, 1.5, 2.5, 3.5]
    assert sum(r.delta_B for r in compute_interference(df, config).collect()) == 0
    with pytest.raises(Exception, match="no steady rows"):
        compute_interference(df.withColumn("flag", F.lit(False)), config, "flag").collect()
    with pytest.raises(ValueError, match="coefficient file"):
        compute_interference(df, PipelineConfig())


@pytest.mark.parametrize("model", "abcd")
def test_feature_columns(spark, model):
    out = build_feature_matrix(spark.createDataFrame(valid()), PipelineConfig(model_terms=model))
    assert out.columns[2:] == list(TERMS[model]) and len(TERMS[model]) == N_TERMS[model] == {"a": 3, "b": 9, "c": 18, "d": 21}[model]


def test_derivatives_against_numpy(spark):
    rng = np.random.default_rng(2)
    pdf = valid(30).assign(time=np.cumsum(rng.uniform(0.1, 1, 30)), B_x=rng.normal(0, 100, 30), B_y=rng.normal(0, 100, 30), B_z=rng.normal(200, 30, 30))
    b = pdf[["B_x", "B_y", "B_z"]].to_numpy()
    cos = b / np.linalg.norm(b, axis=1, keepdims=True)
    df = spark.createDataFrame(pdf)
    central = build_feature_matrix(df, PipelineConfig(model_terms="d")).orderBy("row_idx").toPandas()
    for i, a in enumerate("xyz"):
        assert np.allclose(central[f"dcos_{a}"], np.gradient(cos[:, i], pdf.time.to_numpy()), atol=1e-12)
        assert np.allclose(central[f"cos_x_dcos_{a}"], cos[:, 0] * np.gradient(cos[:, i], pdf.time.to_numpy()), atol=1e-12)
    causal = build_feature_matrix(df, PipelineConfig(model_terms="d", use_cv=True)).orderBy("row_idx").toPandas()
    step = np.diff(cos[:, 1]) / np.diff(pdf.time)
    assert np.allclose(causal["dcos_y"], np.r_[step[0], step], atol=1e-12)


def test_feature_errors(spark):
    with pytest.raises(ValueError, match="2 rows"):
        build_feature_matrix(spark.createDataFrame(valid(1)), PipelineConfig(model_terms="c"))
    assert build_feature_matrix(spark.createDataFrame(valid(1)), A).count() == 1
    with pytest.raises(ValueError, match="use_imu_rates"):
        build_feature_matrix(spark.createDataFrame(valid()), PipelineConfig(model_terms="c", use_imu_rates=True))
    with pytest.raises(Exception, match="magnitude"):
        build_feature_matrix(spark.createDataFrame(valid().assign(B_x=0.0, B_y=0.0, B_z=0.0)), A).collect()


# -- calibration ------------------------------------------------------------
def design(pdf):
    b = pdf[["B_x", "B_y", "B_z"]].to_numpy()
    return b / np.linalg.norm(b, axis=1, keepdims=True)


def test_exact_recovery_and_report(spark):
    pdf = random_directions(80)
    df, s = spark.createDataFrame(pdf), segments(spark, ("steady", "N", 0, 40), ("pitch", "E", 40, 80))
    result = calibrate(df, s, A)
    assert np.allclose(result.coefficients, [1, -2, 0.5], atol=1e-10)
    assert np.allclose(result.singular_values, np.linalg.svd(design(pdf), compute_uv=False))
    report = compute_fom_report(df, s, result)
    assert report.improvement_ratio > 1e10 and list(report.per_maneuver) == ["steady", "pitch"] and report.per_heading["E"].n_samples == 40
    out = compensate(df, result, A).toPandas()
    assert np.allclose(out.tmi_compensated, 50000.0, atol=1e-9) and len(out) == 80
    with pytest.raises(ValueError, match="coefficients"):
        compensate(df, result, PipelineConfig(model_terms="b"))
    with pytest.raises(ValueError, match="residuals"):
        compute_fom_report(df, segments(spark, ("steady", "N", 0, 30)), result)


def test_solvers_against_direct_formulas():
    rng = np.random.default_rng(0)
    a, y = rng.normal(size=(120, 4)), rng.normal(size=120)
    part = linalg.Part.merged([linalg.Part.of(np.c_[a, y][i : i + 7]) for i in range(0, 120, 7)])
    assert part.n == 120 and np.allclose(linalg.solve_ols(part), np.linalg.lstsq(a, y, rcond=None)[0])
    assert np.allclose(linalg.solve_ridge(part, 3.0), np.linalg.solve(a.T @ a + 3 * np.eye(4), a.T @ y))
    w = linalg.solve_elastic(part, 0.02, 0.7)
    grad = a.T @ (a @ w - y) / 120 + 0.02 * 0.3 * w
    assert all(abs(g + 0.02 * 0.7 * np.sign(x)) < 1e-8 if x else abs(g) <= 0.014 + 1e-9 for g, x in zip(grad, w))
    assert part.rss(w) == pytest.approx(np.sum((a @ w - y) ** 2)) and part.spread() == pytest.approx(np.sum((y - y.mean()) ** 2))


def test_vif():
    assert np.allclose(linalg.compute_vif(np.eye(4)), 1)
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 3))
    assert (linalg.compute_vif(np.c_[x, x[:, 0]])[[0, 3]] > 1e10).all()
    assert np.isinf(linalg.compute_vif(np.c_[x, np.ones(200)])[3])
    for bad in (np.ones(3), np.ones((3, 1)), np.ones((1, 3))):
        with pytest.raises(ValueError):
            linalg.compute_vif(bad)


def test_rank_one_minimum_norm(spark):
    pdf = random_directions(20).assign(B_x=3.0, B_y=4.0, B_z=0.0, delta_B=1.0)
    with pytest.warns(UserWarning, match="ill-conditioned"):
        result = calibrate(spark.createDataFrame(pdf), segments(spark, ("steady", "N", 0, 20)), A)
    assert np.allclose(result.coefficients, np.linalg.lstsq(design(pdf), np.ones(20), rcond=None)[0], atol=1e-9)


@pytest.mark.parametrize("method", ["use_ridge", "use_lasso", "use_elastic_net"])
def test_cross_validation_picks_from_folds(spark, method):
    pdf = random_directions(240, noise=0.5, seed=3)
    df, s = spark.createDataFrame(pdf), segments(spark, ("steady", "N", 0, 100), ("pitch", "N", 100, 240))
    result = calibrate(df, s, A.replace(use_cv=True, **{method: True}))
    a, y, k = design(pdf), pdf.delta_B.to_numpy(), 5
    size = 240 // (k + 1)
    cuts = [240 - (k - j) * size for j in range(k)]
    if method == "use_ridge":
        score = []
        for alpha in linalg.ALPHAS:
            r2 = []
            for c in cuts:
                w = np.linalg.solve(a[:c].T @ a[:c] + alpha * np.eye(3), a[:c].T @ y[:c])
                t = y[c : c + size]
                r2.append(1 - np.sum((a[c : c + size] @ w - t) ** 2) / np.sum((t - t.mean()) ** 2))
            score.append(np.mean(r2))
        assert result.selected_alpha == pytest.approx(linalg.ALPHAS[int(np.argmax(score))])
    else:
        top = 2 * np.abs(a.T @ y).max() / (0.5 if method == "use_elastic_net" else 1)
        assert top * 0.999e-3 <= result.selected_alpha <= top * 1.001 and result.effective_dof <= 3


def test_auto_regularize_and_few_rows(spark):
    pdf = random_directions(200, noise=0.01)
    pdf[["B_y", "B_z"]] = pdf[["B_x", "B_x"]].to_numpy() + np.random.default_rng(0).normal(0, 1e-4, (200, 2))
    df, s = spark.createDataFrame(pdf), segments(spark, ("steady", "N", 0, 200))
    with pytest.warns(UserWarning):
        assert calibrate(df, s, A.replace(auto_regularize=True)).selected_alpha == 1e-3
    small = calibrate(spark.createDataFrame(random_directions(2)), segments(spark, ("steady", "N", 0, 2)), A)
    assert len(small.singular_values) == 2 and len(small.coefficients) == 3
    with pytest.raises(ValueError, match="delta_B"):
        calibrate(df.drop("delta_B"), s, A)


def test_headings_and_maneuvers(spark):
    rng = np.random.default_rng(1)
    frames, listed, truth = [], [], {}
    for i, h in enumerate("NESW"):
        truth[h] = rng.normal(size=3)
        frames.append(random_directions(60, truth[h], seed=i).assign(heading=90.0 * i + 2, row_idx=np.arange(60) + 60 * i, time=np.arange(60.0)))
        listed.append((("steady", "pitch", "roll", "yaw")[i], h, 60 * i, 60 * i + 60))
    df, s = spark.createDataFrame(pd.concat(frames)), segments(spark, *listed)
    by = calibrate_per_heading(df, s, A)
    assert by.reference_heading_deg == pytest.approx(2.0) and all(np.allclose(by.per_heading[h].coefficients, truth[h]) for h in "NESW")
    assert all(len(v) == 3 for v in by.per_heading_vif.values())
    assert np.allclose(compensate_heading_specific(df, by, A).toPandas().tmi_compensated, 50000.0, atol=1e-8)
    lost = compensate_heading_specific(df.withColumn("heading", F.lit(float("nan"))), by, A)
    assert lost.where("tmi_compensated != B_total").count() == 0
    adaptive = calibrate_adaptive_maneuvers(df, s, A)
    assert np.allclose(adaptive.roll.coefficients, truth["S"])
    same = type(adaptive)(*[adaptive.pitch] * 4, 3)
    plain, blend = compensate(df, adaptive.pitch, A).toPandas(), compensate_adaptive(df, same, A).toPandas()
    assert np.allclose(plain.sort_values("row_idx").tmi_compensated, blend.sort_values("row_idx").tmi_compensated)
    with pytest.raises(ValueError, match="No segments"):
        calibrate_adaptive_maneuvers(df, s.where("maneuver != 'yaw'"), A)
    assert fit_models(df, s, A, ["flight_id"]).count() == 1 and stacked(df, s, A).count() == 240


def test_rolling_variance(spark):
    pdf = random_directions(40)
    x = design(pdf)[:, 0]
    df = spark.createDataFrame(pdf.assign(c=x))
    for w in (1, 7, 100):
        got = rolling_variance(df, {"c": "v"}, w).orderBy("row_idx").toPandas().v
        assert np.allclose(got, [np.var(x[max(0, i - w + 1) : i + 1]) for i in range(40)], atol=1e-12)


# -- online -----------------------------------------------------------------
@pytest.mark.parametrize("lam", [1.0, 0.95])
def test_batch_equals_recursion(spark, lam):
    pdf = random_directions(60, noise=0.1)
    start = CalibrationResult(np.array([0.3, 0.1, -0.2]), None, 1.0, np.ones(3), 3)
    state = first = rls.initialize_rls(start, lam, initial_covariance_scale=10.0)
    for a, y in zip(design(pdf), pdf.delta_B):
        state = rls.update_rls(state, a, y)
    batch = rls.update_rls_batch(first, spark.createDataFrame(pdf), A)
    assert np.allclose(batch.theta, state.theta, atol=1e-9) and np.allclose(batch.covariance, state.covariance, atol=1e-9) and batch.n_samples == 60
    result = rls.rls_to_calibration_result(batch, spark.createDataFrame(pdf), A)
    assert result.n_samples == 60 and result.condition_number == pytest.approx(np.linalg.cond(design(pdf)))


def test_online_errors():
    start = CalibrationResult(np.zeros(3), None, 1.0, np.ones(3), 3)
    for bad in ({"forgetting_factor": 0.0}, {"forgetting_factor": 1.1}, {"initial_covariance_scale": 0.0}):
        with pytest.raises(ValueError):
            rls.initialize_rls(start, **bad)
    with pytest.raises(ValueError):
        rls.update_rls(rls.initialize_rls(start), np.zeros(4), 1.0)


def test_streams(spark, tmp_path):
    from fluxspan.streaming.live import compensate_stream, rls_stream

    pdf = random_directions(120, noise=0.05)
    schema = spark.createDataFrame(pdf).schema
    for i in range(3):
        pdf[i * 40 : i * 40 + 40].to_parquet(tmp_path / f"part{i}.parquet")
    source = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path))
    query = rls_stream(source(), A, np.zeros(3), 100 * np.eye(3), 0.98).writeStream.format("memory").queryName("rls_out").outputMode("update").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c1")).start()
    query.awaitTermination(120)
    last = spark.sql("select * from rls_out order by n_samples desc").first()
    state = rls.RLSState(np.zeros(3), 100 * np.eye(3), 0.98, 0, 3)
    for a, y in zip(design(pdf), pdf.delta_B):
        state = rls.update_rls(state, a, y)
    assert last.n_samples == 120 and np.allclose(last.theta, state.theta, atol=1e-9)
    result = CalibrationResult(np.array([1.0, -2.0, 0.5]), None, 1.0, np.ones(3), 3)
    live = compensate_stream(source(), result, A).writeStream.format("memory").queryName("live_out").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c2")).start()
    live.awaitTermination(120)
    batch = compensate(spark.createDataFrame(pdf), result, A)
    assert spark.table("live_out").select("row_idx", F.round("tmi_compensated", 6)).exceptAll(batch.select("row_idx", F.round("tmi_compensated", 6))).count() == 0
    with pytest.raises(ValueError, match="use_imu_rates"):
        compensate_stream(source(), result, PipelineConfig(model_terms="c"))


def test_rls_result_uses_each_flights_own_state(spark, monkeypatch):
    from fluxspan.plans import flight_queries

    one = random_directions(60, (1.0, -2.0, 0.5), seed=1).assign(flight_id=3)
    two = random_directions(50, (-4.0, 7.0, 2.0), seed=2).assign(flight_id=8)
    df = spark.createDataFrame(pd.concat([one, two]))
    monkeypatch.setattr(flight_queries, "_delta", lambda spark, d: (df, None))
    assert sorted(tuple(r) for r in flight_queries.rls_result_a(spark, None).collect()) == [(3, 0.0, 60), (8, 0.0, 50)]


# -- ensembles --------------------------------------------------------------
def test_ensembles(spark):
    pdf = random_directions(300, seed=4)
    cos = design(pdf)
    pdf["delta_B"] = 2 * cos[:, 0] + 1.5 * cos[:, 1] ** 2 - 0.8 * cos[:, 2]
    df, s = spark.createDataFrame(pdf), segments(spark, ("steady", "N", 0, 300))
    result = nn.calibrate_nn(df, s, nn.NNConfig(hidden_layer_sizes=(16,), n_estimators=4, max_iter=60))
    out = nn.predict_nn(df, result).toPandas()
    assert (out.nn_std > 0).mean() > 0.9 and result.residuals.count() == 300
    assert np.std(out.nn_mean - out.delta_B) < np.std(out.delta_B)
    done = nn.compensate_nn(df, result).toPandas().sort_values("row_idx")
    assert np.allclose(done.tmi_compensated, done.B_total - out.sort_values("row_idx").nn_mean)
    config = nn.PINNConfig(hidden_layer_sizes=(16,), n_estimators=3, max_iter=150, tl_model_terms="a", nn_feature_terms="b")
    pinn = nn.calibrate_pinn(df, s, config)
    rms = lambda r: np.sqrt(np.mean(r.toPandas().residual ** 2))
    assert rms(pinn.residuals) <= rms(pinn.linear.residuals)
    assert nn.compensate_pinn(df, pinn).columns == [*df.columns, "tmi_compensated"]
    for bad in ({"n_estimators": 0}, {"physics_lambda": -1.0}, {"physics_lambda": float("inf")}):
        with pytest.raises(ValueError):
            nn.calibrate_pinn(df, s, nn.PINNConfig(**bad))


def test_members_draw_from_all_rows(spark, monkeypatch):
    pdf = random_directions(700, seed=5)
    df, s = spark.createDataFrame(pdf).repartition(5), segments(spark, ("steady", "N", 0, 700))
    config = nn.NNConfig(hidden_layer_sizes=(4,), n_estimators=3, max_iter=3)
    x = pdf[["B_x", "B_y", "B_z"]].to_numpy()
    x = (x - x.mean(axis=0)) / x.std(axis=0)
    for i, member in enumerate(nn.calibrate_nn(df, s, config).ensemble.members):
        pick = np.random.default_rng(42 + i).integers(0, 700, 700)
        want = nn.train_member(x[pick], pdf.delta_B.to_numpy()[pick], config, 42 + i)
        assert all(np.allclose(a, b, atol=1e-6) for p, q in zip(member, want) for a, b in zip(p, q))
    # the registered queries fit as the operator does by default, with no bound on its rows
    from fluxspan.plans import flight_queries

    seen = []
    for name in ("calibrate_nn", "calibrate_pinn"):
        monkeypatch.setattr(nn, name, lambda df, segments, config=nn.NNConfig(): seen.append(config))
    monkeypatch.setattr(flight_queries, "_delta", lambda spark, d: (None, None))
    for name in ("nn_predict", "nn_compensate", "pinn_predict"):
        with pytest.raises(AttributeError):
            flight_queries.QUERIES[name](None, None)
    assert [(c.hidden_layer_sizes, c.max_iter, c.n_estimators) for c in seen] == [((64, 64), 500, 20)] * 3
    assert not any(hasattr(c, "max_training_rows") for c in seen)


def test_each_member_is_trained_once(spark, tmp_path):
    log = str(tmp_path / "fits")

    class Rounds:
        def __index__(self):  # asked for by each training
            with open(log, "a") as f:
                f.write("x")
            return 2

    pdf = random_directions(120, seed=6)
    nn.calibrate_nn(spark.createDataFrame(pdf), segments(spark, ("steady", "N", 0, 120)), nn.NNConfig(hidden_layer_sizes=(4,), n_estimators=3, max_iter=Rounds()))
    assert open(log).read() == "xxx"


def test_each_member_above_the_linear_model_is_trained_once(spark, tmp_path):
    log = str(tmp_path / "fits")

    class Rounds:
        def __index__(self):  # asked for by each training
            with open(log, "a") as f:
                f.write("x")
            return 2

    pdf = random_directions(120, seed=6)
    config = nn.PINNConfig(hidden_layer_sizes=(4,), n_estimators=2, max_iter=Rounds(), tl_model_terms="a")
    nn.calibrate_pinn(spark.createDataFrame(pdf), segments(spark, ("steady", "N", 0, 120)), config)
    assert open(log).read() == "xx"


def test_members_trained_side_by_side_end_as_alone():
    pdf = random_directions(900, seed=9, noise=0.1)
    held = np.c_[pdf[["B_x", "B_y", "B_z"]] / 30_000, pdf.delta_B / pdf.delta_B.std()].astype(nn.SINGLE)
    picks = [np.random.default_rng(i).integers(0, len(held), 450) for i in range(3)]
    for activation in ("relu", "tanh", "logistic", "identity"):
        config = nn.NNConfig(hidden_layer_sizes=(8, 6), activation=activation, max_iter=400)
        together = nn._descend(held, picks, config, [5, 6, 7], 1e-3)
        for i, flat in enumerate(together):  # they stop in different epochs
            (alone,) = nn._descend(held, picks[i : i + 1], config, [5 + i], 1e-3)
            assert np.allclose(flat, alone, atol=2e-2)
    assert nn._groups(20, 8) == [[0, 1, 2], [3, 4, 5], [6, 7, 8], [9, 10, 11], [12, 13], [14, 15], [16, 17], [18, 19]]
    assert [len(g) for g in nn._groups(20, 4)] == [3] * 4 + [2] * 4 and [len(g) for g in nn._groups(20, 64)] == [1] * 20


def test_repeated_segments_count_as_often_as_listed_above_the_linear_model(spark):
    s = segments(spark, ("steady", "N", 0, 120))
    config = nn.PINNConfig(hidden_layer_sizes=(4,), n_estimators=2, max_iter=2, tl_model_terms="a")
    result = nn.calibrate_pinn(spark.createDataFrame(random_directions(120, seed=6)), s.union(s), config)
    assert result.linear.residuals.count() == result.residuals.count() == 240


def test_rows_are_packed_once_and_in_order(spark):
    pdf = pd.concat([random_directions(n, seed=n).assign(flight_id=i) for i, n in enumerate((150, 1, 70))])
    df = spark.createDataFrame(pdf.sample(frac=1, random_state=0)).repartition(4)
    blocks = nn._packed(df, ["B_x", "B_y", "B_z"], "delta_B", np.zeros(3), np.full(3, 50_000.0)).collect()
    held = np.frombuffer(b"".join(b.data for b in sorted(blocks)), nn.SINGLE).reshape(-1, 4)
    assert np.allclose(held, np.c_[pdf[["B_x", "B_y", "B_z"]] / 50_000, pdf.delta_B], atol=1e-6)


def test_single_precision_fits_as_double_does(monkeypatch):
    pdf = random_directions(2000, seed=7, noise=0.1)
    x = pdf[["B_x", "B_y", "B_z"]].to_numpy() / 30_000
    for activation in ("relu", "tanh", "logistic", "identity"):
        config, left = nn.NNConfig(hidden_layer_sizes=(16, 8), activation=activation, max_iter=40), {}
        for kind in (np.float32, np.float64):
            monkeypatch.setattr(nn, "SINGLE", kind)
            left[kind] = np.std(nn.forward(x, nn.train_member(x, pdf.delta_B, config, 3), activation)[:, 0] - pdf.delta_B)
        assert left[np.float32] == pytest.approx(left[np.float64], rel=0.02) and left[np.float32] < 0.5 * pdf.delta_B.std()


def test_only_features_go_through_python(spark):
    pdf = random_directions(100, seed=8)
    df, s = spark.createDataFrame(pdf), segments(spark, ("steady", "N", 0, 100))
    result = nn.calibrate_nn(df, s, nn.NNConfig(hidden_layer_sizes=(4,), n_estimators=2, max_iter=2))
    unread = df.withColumn("unread", F.raise_error(F.lit("was read")).cast("string"))
    got = nn.predict_nn(unread, result).select("row_idx", "nn_mean", "nn_std").toPandas().sort_values("row_idx")
    mean, std = result.ensemble.predict(pdf[["B_x", "B_y", "B_z"]].to_numpy())
    assert np.allclose(got.nn_mean, mean) and np.allclose(got.nn_std, std)


def test_whole_pipeline(spark):
    df = validate_dataframe(spark.createDataFrame(synthetic_flight()))
    config = PipelineConfig(model_terms="b", earth_field_method="steady_mean", segment_label_col="segment")
    s = seg.segment_fom(df, config)
    delta = compute_interference(seg.steady_rows(df, s), config, "steady")
    result = calibrate(delta, s, config)
    assert compute_fom_report(delta, s, result).improvement_ratio > 10
    assert compensate(df, result, config).count() == 800


def test_public_names(spark):
    import fluxspan

    for name in dir(fluxspan):
        assert getattr(fluxspan, name) is not None
    with pytest.raises(AttributeError):
        fluxspan.no_such_name
    listed = fluxspan.segments_frame(spark, [fluxspan.Segment("steady", "N", 0, 5), fluxspan.Segment("yaw", "E", 5, 9)])
    assert [r.seg_ord for r in listed.orderBy("seg_ord").collect()] == [1, 2]
