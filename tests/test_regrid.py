import numpy as np
import pandas as pd
import pytest

from fluxspan.operators.regrid import fill_cells, impute_holes, regular_grid, ssa_impute


def rows(flight, times, value=None):
    times = np.asarray(times, float)
    value = 100 + np.sin(times / 7) if value is None else value
    return pd.DataFrame({"flight_id": flight, "row_idx": np.arange(len(times)), "time_s": times, "b_total": value, "b_x": value * 2, "cell": -1, "status": "clash"})


def brute(pdf, channel):
    """Whole seconds strictly between successive usable readings at most 900 s apart."""
    used = pdf[pdf.time_s.notna() & pdf[channel].notna()].drop_duplicates(["flight_id", "row_idx"])
    out = set()
    for f, g in used.groupby("flight_id"):
        t = np.sort(g.time_s.to_numpy())
        for a, b in zip(t[:-1], t[1:]):
            if b - a <= 900:
                out |= {(f, c) for c in range(int(np.floor(a)) + 1, int(np.floor(b)))}
    return out


def test_imputation_follows_an_oscillation():
    x = 10 + np.sin(np.arange(200) / 5)
    hole = np.zeros(200, bool)
    hole[np.r_[30:42, 90, 150:156]] = True
    filled, _ = impute_holes(np.where(hole, np.nan, x), hole, ~hole | hole)
    linear = np.interp(np.arange(200), np.flatnonzero(~hole), x[~hole])
    assert np.abs(filled - x)[hole].max() < 0.4
    assert np.abs(filled - x)[hole].mean() < 0.5 * np.abs(linear - x)[hole].mean()


@pytest.mark.parametrize("length", [12, 60, 200, 600, 850])
@pytest.mark.parametrize("noise", [0.0, 0.2])
def test_long_holes_beat_a_straight_line(length, noise):
    t = np.arange(4000)
    course = 5 * np.sin(t / 12)
    x = course + noise * np.random.default_rng(4).normal(size=len(t))
    hole = np.zeros(len(t), bool)
    hole[2000 : 2000 + length] = True
    filled, done = impute_holes(np.where(hole, np.nan, x), hole, np.ones(len(t), bool))
    assert (done == hole).all()
    error = lambda y: np.sqrt(np.mean((y - course)[hole] ** 2))
    linear = np.interp(t, t[~hole], x[~hole])
    assert error(filled) < (0.1 if noise == 0 else 0.6) * error(linear) or error(filled) < 2 * noise


def test_unforeseeable_long_hole_stays_near_the_straight_line():
    walk = np.cumsum(np.random.default_rng(1).normal(size=2000))
    hole = np.zeros(2000, bool)
    hole[900:1200] = True
    filled, _ = impute_holes(np.where(hole, np.nan, walk), hole, np.ones(2000, bool))
    linear = np.interp(np.arange(2000), np.flatnonzero(~hole), walk[~hole])
    off = lambda y: np.sqrt(np.mean((y - walk)[hole] ** 2))
    assert off(filled) < 1.25 * off(linear)


def test_faulty_readings_do_not_shape_their_surroundings():
    x = 10 + np.sin(np.arange(300) / 9)
    x[146] = 1e6
    hole = np.zeros(300, bool)
    hole[150:154] = True
    filled, _ = impute_holes(np.where(hole, np.nan, x), hole, np.ones(300, bool))
    assert filled[146] == 1e6 and np.abs(filled - 10 - np.sin(np.arange(300) / 9))[hole].max() < 0.1


def test_holes_across_chunks_come_out_once_and_whole(spark):
    t = np.arange(0, 9000) + 0.5
    t = t[((t < 3900) | (t > 4700)) & (t.astype(int) % 7 > 0)]
    df = spark.createDataFrame(rows(1, t))
    small, large = (regular_grid(df, c).where("channel = 'b_total'").toPandas().sort_values("cell") for c in (2048, 16384))
    assert small["cell"].tolist() == large["cell"].tolist() == list(range(1, 8999 if t[-1] < 8999 else 9000))
    wrong = small["value"].to_numpy() - (100 + np.sin((small["cell"].to_numpy() + 0.5) / 7))
    assert np.abs(wrong).max() < 0.2


def test_imputation_edge_cases():
    none = np.array([np.nan, np.nan])
    assert np.isnan(ssa_impute(none, np.array([True, True]))).all()
    assert ssa_impute(np.array([1.0, np.nan, 3.0]), np.array([False, True, False])).tolist() == [1, 2, 3]
    flat = np.r_[np.full(20, 5.0), np.nan, np.full(20, 5.0)]
    assert (ssa_impute(flat, np.isnan(flat)) == 5).all()


def test_pauses_are_not_filled():
    cells, values, filled = fill_cells(np.array([0, 3, 2000]), np.array([0.1, 3.2, 2000.0]), np.array([0.5, 3.9, 2000.0]), np.array([1.0, 4.0, 9.0]))
    assert cells.tolist() == [0, 1, 2, 3, 2000] and filled.tolist() == [False, True, True, False, False]
    assert np.allclose(values[:4], [1, 2, 3, 4])


def test_operator_equals_brute_force(spark):
    rng = np.random.default_rng(5)
    t = np.sort(rng.uniform(0, 6000, 700))
    t = t[(t < 1500) | (t > 2600)]  # a pause of about 1100 s
    a = rows(1, t)
    a.loc[::17, "b_x"] = np.nan
    a.loc[3, "time_s"] = np.nan
    b = rows(2, [10.0, 910.0, 1811.0, 1811.5])
    both = pd.concat([a, b, a.head(50), rows(3, []), rows(4, [5.5], np.array([np.inf]))])
    df = spark.createDataFrame(both.sample(frac=1, random_state=1))
    for chunk in (2048, 4096):
        out = regular_grid(df, chunk).toPandas()
        assert not out.duplicated(["flight_id", "cell", "channel"]).any()
        for channel in ("b_total", "b_x"):
            got = {(r.flight_id, r.cell) for r in out[(out.status == "filled") & (out.channel == channel)].itertuples()}
            assert got == brute(both, channel)
        assert out[out.flight_id < 3].value.notna().all()


def test_repeated_deliveries_do_not_weigh(spark):
    df = pd.DataFrame({"flight_id": [1, 1, 1], "row_idx": [0, 0, 1], "time_s": [5.1, 5.1, 5.2], "b_total": [10.0, 10.0, 20.0], "b_x": [1.0, 1.0, 1.0]})
    out = regular_grid(spark.createDataFrame(df)).where("channel = 'b_total'").collect()
    assert [(r.cell, r.value, r.status) for r in out] == [(5, 15.0, "observed")]


def test_empty(spark):
    assert regular_grid(spark.createDataFrame(rows(1, [1.0])).limit(0)).count() == 0
