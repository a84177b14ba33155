import numpy as np
import pandas as pd
import pytest

from fluxspan.operators.spikes import find_spikes, implausible_readings, judge_channel, stuck_readings, wavelet_details

AIRCRAFT = pd.DataFrame({"aircraft_id": [1], "airframe": ["x"], "mag_min_nt": [20000.0], "mag_max_nt": [80000.0], "fluxgate_max_nt": [70000.0], "max_rate_rad_s": [1.0]})
FLIGHTS = pd.DataFrame({"flight_id": [1, 2], "aircraft_id": [1, 1], "extra": ["a", "b"]})


def course(n, seed=0, sigma=0.5):
    rng = np.random.default_rng(seed)
    return 50000 + 20 * np.sin(np.arange(n) / 25) + rng.normal(0, sigma, n)


def brute_spikes(y, sigma):
    """Plain rule, every block of up to three: the parabola through six readings
    on either side fits those to twice the scatter and misses the block by eight."""
    out = set()
    for w in (1, 2, 3):
        for i in range(6, len(y) - w - 6):
            at = np.r_[i - 6 : i, i + w : i + w + 6]
            curve = np.poly1d(np.polyfit(at - i, y[at], 2))
            calm = np.sqrt(np.mean((curve(at - i) - y[at]) ** 2)) <= 2 * sigma
            if calm and np.abs(curve(np.arange(w)) - y[i : i + w]).min() >= 8 * sigma:
                out |= set(range(i, i + w))
    return out


def test_details_vanish_on_a_smooth_course():
    y = course(300)
    details = wavelet_details(y)
    assert len(details) == 3 and all(len(d) == 300 for d in details)
    assert np.abs(wavelet_details(np.ones(50))[0]).max() < 1e-12
    cubic = (np.arange(60) / 10.0) ** 3
    assert max(np.abs(d[12:-12]).max() for d in wavelet_details(cubic)) < 1e-9


@pytest.mark.parametrize("width", [1, 2, 3])
def test_planted_spikes_are_found(width):
    y = course(2000)
    planted = set()
    for k, at in enumerate(range(50, 1900, 60)):
        y[at : at + width] += (-1) ** k * (12 + k)
        planted |= set(range(at, at + width))
    flags, _ = find_spikes(y)
    assert set(np.flatnonzero(flags)) == planted
    assert brute_spikes(y, 0.5) == planted


def test_steps_turns_and_rough_air_are_no_spikes():
    rng = np.random.default_rng(1)
    y = course(1500)
    y[500:] += 40
    y[900:1100] += np.cumsum(np.hanning(200))
    y[1200:1300] += rng.normal(0, 3, 100)
    assert find_spikes(y)[0].sum() <= 1


def test_stuck_runs():
    v = course(200)
    v[50:62] = v[50]
    v[100:109] = v[100]  # one too few
    assert np.flatnonzero(stuck_readings(v, 0.01)).tolist() == list(range(50, 62))
    assert not stuck_readings(v, float("nan")).any()
    assert not stuck_readings(v[:5], 0.01).any()


def test_infinite_readings_break_limits():
    v = np.r_[course(60), np.inf, -np.inf]
    outside, stuck, spike, _ = judge_channel(v, 20000, 80000, 0.01)
    assert np.flatnonzero(outside).tolist() == [60, 61] and not stuck.any() and not spike.any()


def frame(flight, y, start=0):
    n = len(y)
    return pd.DataFrame({"row_id": np.arange(n) + 10_000 * flight, "flight_id": flight, "row_idx": np.arange(start, start + n), "segment": "steady_N", "b_total": y, "b_x": y / 4, "roll_rate": 0.01 * np.sin(np.arange(n) / 9), "chunk": "clash", "steady": 1})


def test_operator_same_for_any_chunking_and_repeats(spark):
    y = course(1200)
    y[[100, 255, 256, 700]] += 30
    y[400] = 95000.0
    y[20] = np.nan
    rows = pd.concat([frame(1, y), frame(1, y).head(300).assign(row_id=-1), frame(2, course(150, 3))])
    rows.loc[rows.index[5], "b_x"] = None
    df = spark.createDataFrame(rows)
    df = df.unionByName(df.limit(1).selectExpr(*["cast(null as bigint) as flight_id" if c == "flight_id" else c for c in df.columns]))
    found = {}
    for chunk in (256, 8192):
        out = implausible_readings(df, spark.createDataFrame(FLIGHTS), spark.createDataFrame(AIRCRAFT), chunk).toPandas()
        assert not out.duplicated(["flight_id", "row_idx", "channel"]).any()
        found[chunk] = {(r.flight_id, r.row_idx, r.channel) for r in out.itertuples()}
    assert found[256] == found[8192]
    assert {(1, i, "b_total") for i in (100, 255, 256, 700, 400)} <= found[8192]
    assert all(f == 1 for f, _, _ in found[8192])


def test_chunk_borders_amid_nulls(spark):
    """A stuck run and a spike are whole though nulls part them at chunk borders,
    over several chunks without any reading."""
    y = course(4000, 5)
    y[[*range(1014, 1019), *range(2500, 2505)]] = y[1014]
    y[1019:2500] = np.nan
    y[2049] = y[2050] = np.nan
    z = course(4000, 6)
    z[3060:3100] = np.nan
    z[3059] += 40
    rows = pd.concat([frame(1, y), frame(2, z)]).assign(b_x=1.0, roll_rate=0.5)
    df = spark.createDataFrame(rows)
    found = {}
    for chunk in (256, 512, 8192):
        out = implausible_readings(df, spark.createDataFrame(FLIGHTS), spark.createDataFrame(AIRCRAFT), chunk).where("channel = 'b_total'").toPandas()
        found[chunk] = {(r.flight_id, r.row_idx) for r in out.itertuples()}
    stuck = {(1, i) for i in [*range(1014, 1019), *range(2500, 2505)]}
    assert stuck | {(2, 3059)} <= found[8192]
    assert found[256] == found[512] == found[8192]


def test_threshold_on_details_decides():
    y = course(2000)
    for at in range(100, 1900, 100):
        y[at] += 5.5
    few, many = find_spikes(y, 15.0)[0].sum(), find_spikes(y, 6.0)[0].sum()
    assert few < 4 < 14 < many


def test_operator_on_unknown_aircraft_and_empty(spark):
    df = spark.createDataFrame(frame(9, course(100)))
    out = implausible_readings(df, spark.createDataFrame(FLIGHTS), spark.createDataFrame(AIRCRAFT))
    assert out.count() == 0
    assert implausible_readings(df.limit(0), spark.createDataFrame(FLIGHTS).limit(0), spark.createDataFrame(AIRCRAFT)).count() == 0
