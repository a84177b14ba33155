import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fluxspan.llm import quantiles, runs
from fluxspan.llm.labels import heading_name, maneuver_name

DDL = "segment_id bigint, flight_id bigint, maneuver string, heading string, start_idx bigint, end_idx bigint, chunk string, label string"


def frame(spark, rows):
    return spark.createDataFrame([(i, *r, "clash", "clash") for i, r in enumerate(rows)], DDL)


@pytest.mark.parametrize("text, name", [(" Steady.", "steady"), ("steday", "steady"), ("rloll", "roll"), ("yew", "yaw"), ("ywa", "yaw"), ("maneuver:pitch", "pitch"), ("(roll)", "roll"), ("pitch-leg", "pitch"), (" yaw\t", "yaw"), ("roll1", "roll"), ("hover", None), ("", None), (None, None), ("pit", None), ("ptihc", None)])
def test_maneuver_spellings(spark, text, name):
    assert spark.createDataFrame([(text,)], "x string").select(maneuver_name(F.col("x")).alias("m")).first()["m"] == name


@pytest.mark.parametrize("text, name", [("n", "N"), ("WEST", "W"), ("Southbound", "S"), (" E.", "E"), ("12°", "N"), ("282 deg", "W"), ("045", "N"), ("135", "E"), ("225", "S"), ("315.0", "N"), ("-10", "N"), ("725", "N"), ("NE", None), ("SSW", None), ("n/a", None), ("--", None), ("", None), (None, None)])
def test_heading_spellings(spark, text, name):
    assert spark.createDataFrame([(text,)], "x string").select(heading_name(F.col("x")).alias("h")).first()["h"] == name


def brute(rows):
    """Records in order, one after the other."""
    out = []
    for flight in {r[0] for r in rows if r[0] is not None}:
        mine = {r for r in rows if r[0] == flight and r[3] is not None and r[4] is not None and r[4] > r[3]}
        known = lambda m, h: m in ("steady", "pitch") and h in ("N", "E")
        key = lambda r: (r[3], r[4], r[1] or "" if r[1] in ("steady", "pitch") else "", r[2] or "" if r[2] in ("N", "E") else "", r[1] or "", r[2] or "")
        current = None
        for _, m, h, a, b in sorted(mine, key=key):
            if not known(m, h):
                current = None
                continue
            if current and current[1:3] == [m, h] and a <= current[4] + 50:
                current[4] = max(current[4], b)
                current[5] += 1
            else:
                current = [flight, m, h, a, b, 1]
                out.append(current)
    return sorted(map(tuple, out))


record = st.tuples(st.sampled_from([1, 2, None]), st.sampled_from(["steady", "pitch", "hover", None]), st.sampled_from(["N", "E", "?", None]), st.one_of(st.none(), st.integers(0, 600)), st.one_of(st.none(), st.integers(0, 700)))


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.too_slow, HealthCheck.function_scoped_fixture])
@given(st.lists(record, min_size=1, max_size=60))
def test_runs_equal_brute_force(spark, rows):
    for chunk in (64, 65_536):
        before, runs.CHUNK = runs.CHUNK, chunk
        try:
            got = runs.collapse_runs(frame(spark, rows)).select("flight_id", "maneuver", "heading", "start_idx", "end_idx", "n_records").collect()
        finally:
            runs.CHUNK = before
        assert sorted(tuple(r) for r in got) == brute(rows)


def test_run_durations_and_empty(spark):
    df = frame(spark, [(1, "steady", "N", 0, 5), (1, "STEADY", "north", 5, 9), (2, "yaw", "S", 0, 3)])
    rows = spark.createDataFrame([(1, i, float(10 * i)) for i in range(8)] + [(1, 8, None)], "flight_id bigint, row_idx bigint, time_s double")
    out = {r.flight_id: r for r in runs.run_durations(runs.collapse_runs(df), rows).collect()}
    assert (out[1].n_records, out[1].n_rows, out[1].seconds) == (2, 9, 70.0) and out[2].seconds is None
    assert [tuple(r) for r in runs.repeated_runs(runs.collapse_runs(df)).collect()] == [(1, 0, 9)]
    assert runs.collapse_runs(df.limit(0)).count() == 0


def test_percentiles_within_the_bound(spark):
    rng = np.random.default_rng(0)
    values = np.r_[rng.standard_cauchy(5000) * 100, np.zeros(50), rng.normal(0, 1e-6, 500)]
    pdf = pd.DataFrame({"g": np.arange(len(values)) % 3, "x": values})
    df = spark.createDataFrame(pdf).unionByName(spark.createDataFrame([(0, None), (0, float("nan")), (1, float("inf"))], "g bigint, x double"))
    parts = [quantiles.sketch(df.where(F.rand(1) < 0.3), ["g"], "x"), quantiles.sketch(df.where(F.rand(1) >= 0.3), ["g"], "x")]
    whole = quantiles.percentiles(quantiles.merge(parts[0].unionByName(parts[1]), ["g"]), ["g"], range(0, 101, 5)).toPandas().set_index("g")
    direct = quantiles.percentiles(quantiles.sketch(df, ["g"], "x"), ["g"], range(0, 101, 5)).toPandas().set_index("g")
    assert whole.sort_index().equals(direct.sort_index())
    for g, x in pdf.groupby("g").x:
        x = np.sort(x.to_numpy())
        assert direct.loc[g, "n"] == len(x)
        for p in range(0, 101, 5):
            exact = x[max(0, int(np.ceil(p / 100 * len(x))) - 1)]
            assert abs(direct.loc[g, f"p{p:02d}"] - exact) <= quantiles.ERROR * abs(exact) * (1 + 1e-9)


def test_absurd_bounds_list_no_blocks_without_rows(spark):
    far = 10**15
    s = frame(spark, [(1, "roll", "N", 0, far), (1, "yaw", "E", -far, 3), (1, "pitch", "S", far, 2 * far)])
    rows = spark.createDataFrame([(1, i, float(i), float(i + 1)) for i in range(600)], "flight_id bigint, row_idx bigint, time_s double, delta_b double")
    assert {(r.maneuver, r.n) for r in quantiles.segment_percentiles(rows, s).collect()} == {("roll", 600), ("yaw", 3)}
    durations = {r.maneuver: (r.n_rows, r.seconds) for r in runs.run_durations(runs.collapse_runs(s), rows).collect()}
    assert durations == {"roll": (far, 599.0), "yaw": (far + 3, 2.0), "pitch": (far, None)}


def test_extreme_values(spark):
    values = [5e-324, -5e-324, 1.7e308, -1.7e308, 0.0, -0.0]
    out = spark.createDataFrame([(v,) for v in values], "x double").select("x", quantiles.bucket_of(F.col("x")).alias("b")).select("x", "b", quantiles.value_of(F.col("b")).alias("v")).collect()
    for r in out:
        assert np.sign(r.v) == np.sign(r.x) and abs(r.v - r.x) <= 0.0101 * abs(r.x) or abs(r.x) < 1e-300


def test_rows_count_once_per_pair(spark):
    s = frame(spark, [(1, "roll", "N", 0, 10), (1, "Roll", "north", 5, 700), (1, "yaw", "E", 5, 8), (1, "yaw", "?", 0, 9), (1, "yaw", "E", 9, 3)])
    rows = spark.createDataFrame([(1, i, float(i)) for i in range(600)] + [(1, 5, 5.0)], "flight_id bigint, row_idx bigint, delta_b double")
    out = {(r.maneuver, r.heading): r.n for r in quantiles.segment_percentiles(rows, s).collect()}
    assert out == {("roll", "N"): 600, ("yaw", "E"): 3}
    assert quantiles.segment_percentiles(rows.limit(0), s).count() == 0


def test_small_percentiles_and_flights_without_a_day(spark):
    rows = spark.createDataFrame([(f, i, x) for f, x in ((1, 3e-12), (2, -4e-8)) for i in range(10)], "flight_id bigint, row_idx bigint, delta_b double")
    segments = spark.createDataFrame([(1, "pitch", "N", 0, 10), (2, "roll", "E", 0, 10)], "flight_id bigint, maneuver string, heading string, start_idx bigint, end_idx bigint")
    flights = spark.createDataFrame([(1, "2020-01-01")], "flight_id bigint, flown_on string")
    found = {r.maneuver: r.p50 for r in quantiles.segment_percentiles(rows, segments).collect()}
    assert abs(found["pitch"] / 3e-12 - 1) < 0.0101 and abs(found["roll"] / -4e-8 - 1) < 0.0101
    daily = quantiles.daily_sketches(rows, segments, flights).collect()
    assert sorted((r.flown_on or "", r.maneuver, r.n) for r in daily) == [("", "roll", 10), ("2020-01-01", "pitch", 10)]
