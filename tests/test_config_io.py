import dataclasses
import datetime as dt
import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from fluxspan.cli import main
from fluxspan.config import PipelineConfig
from fluxspan.operators.baseline import EARTH_RADIUS, coefficients_at, field_strength, read_shc
from fluxspan.operators.calibrate import CalibrationResult
from fluxspan.sources.recordings import coefficient_document, read_coefficients, read_csv, validate_coefficients, write_coefficients


def test_defaults_and_frozen():
    c = PipelineConfig()
    assert (c.model_terms, c.earth_field_method, c.cv_folds, c.heading_tolerance_deg) == ("c", "igrf", 5, 45.0)
    with pytest.raises(dataclasses.FrozenInstanceError):
        c.model_terms = "a"
    assert PipelineConfig(reference_heading_deg=-400.0).reference_heading_deg == -400.0


@pytest.mark.parametrize(
    "bad",
    [{"model_terms": "e"}, {"use_ridge": True, "use_lasso": True}, {"igrf_date": None}, {"bandpass_low_hz": 1.0}, {"bandpass_high_hz": 6.0}, {"cv_folds": 1}, {"ridge_alpha": -1}, {"elastic_net_l1_ratio": 2}, {"heading_tolerance_deg": 0}, {"sample_rate_hz": 0}, {"earth_field_method": "x"}, {"maneuver_detection_window": 0}],
)
def test_refused(bad):
    with pytest.raises(ValueError):
        PipelineConfig(**bad)


DOC = {"model_terms": "a", "coefficients": [1.0, 2.0, 3.0], "n_terms": 3, "condition_number": 2.0}


@pytest.mark.parametrize(
    "change, message",
    [
        ({"model_terms": "z"}, "model_terms"), ({"model_terms": 3}, "model_terms"), ({"coefficients": "x"}, "list"), ({"coefficients": [1.0, "a", 2]}, "numbers"), ({"coefficients": [1.0]}, "1 coefficients"), ({"n_terms": True}, "integer"),
        ({"n_terms": 3.0}, "integer"), ({"n_terms": 4, "coefficients": [1, 2, 3, 4]}, "has 3 terms"), ({"condition_number": float("inf")}, "finite"), ({"condition_number": True}, "number"), ({"singular_values": [1.0]}, "singular_values"),
        ({"singular_values": [1.0, float("nan"), 1.0]}, "finite"), ({"singular_values": [True, 1, 1]}, "finite"), ({"singular_values": None}, "singular_values"),
    ],
)
def test_document_errors(change, message):
    with pytest.raises(ValueError, match=message):
        validate_coefficients(DOC | change)


def test_document_all_errors_and_root():
    with pytest.raises(ValueError) as e:
        validate_coefficients({"n_terms": "x"})
    assert str(e.value).count("is missing") == 3 and "integer" in str(e.value)
    with pytest.raises(ValueError, match="root"):
        validate_coefficients([1])
    assert validate_coefficients(DOC | {"coefficients": [True, float("inf"), 1]})


def test_document_round_trip(tmp_path):
    result = CalibrationResult(np.arange(3.0), None, 2.0, np.array([3.0, 2.0, 1.0]), 3, 0.5, 1.5)
    write_coefficients(result, "a", str(tmp_path / "c.json"))
    back, model = read_coefficients(str(tmp_path / "c.json"))
    assert model == "a" and back.selected_alpha == 0.5 and back.singular_values.tolist() == [3, 2, 1]
    (tmp_path / "d.json").write_text(json.dumps({k: v for k, v in coefficient_document(result, "a").items() if k != "singular_values"}))
    assert np.isnan(read_coefficients(str(tmp_path / "d.json"))[0].singular_values).all()


def test_axial_dipole_field(tmp_path):
    path = tmp_path / "dipole.shc"
    path.write_text("# comment\n1 1 2 2 1\n2020.0 2025.0\n1 0 -30000 -29000\n1 1 0 0\n1 -1 0 0\n")
    g = coefficients_at(*read_shc(str(path)), dt.date(2022, 7, 2))
    assert g[1, 0] == pytest.approx(-29500, abs=2)
    lat, alt = np.array([0.0, 90.0, 45.0]), np.array([0.0, 0.0, 0.3])
    b = field_strength(np.array([10.0, 0.0, -75.0]), lat, alt, g)
    assert b[0] == pytest.approx(29500 * (EARTH_RADIUS / 6378.137) ** 3, rel=2e-4)
    assert b[1] == pytest.approx(2 * 29500 * (EARTH_RADIUS / 6356.752) ** 3, rel=2e-4)
    assert b[0] < b[2] < b[1]


def test_tilted_dipole_equals_rotation():
    """A dipole along x at (lon 0, equator) looks like an axial one at the pole."""
    axial, tilted = {(1, 0): -30000.0}, {(1, 1): -30000.0}
    pole = field_strength(np.array([0.0]), np.array([0.0]), np.array([0.0]), tilted)
    assert pole[0] == pytest.approx(2 * 30000 * (EARTH_RADIUS / 6378.137) ** 3, rel=1e-9)
    assert field_strength(np.array([90.0]), np.array([0.0]), np.array([0.0]), tilted)[0] == pytest.approx(field_strength(np.array([0.0]), np.array([0.0]), np.array([0.0]), axial)[0], rel=1e-9)


def write_flight(path):
    from tests.flights import synthetic_flight

    synthetic_flight().to_csv(path, index=False)


def test_command_line_round_trip(spark, tmp_path, capsys):
    write_flight(tmp_path / "in.csv")
    out, comp = str(tmp_path / "coef.json"), str(tmp_path / "out.csv")
    assert main(["calibrate", str(tmp_path / "in.csv"), "--output", out, "--model-terms", "b", "--earth-field-method", "steady_mean", "--segment-label-col", "segment"]) == 0
    assert json.loads(capsys.readouterr().out.strip().splitlines()[-1])["improvement_ratio"] > 10
    assert main(["compensate", str(tmp_path / "in.csv"), "--coefficients", out, "--output", comp]) == 0
    done, original = pd.read_csv(comp), pd.read_csv(tmp_path / "in.csv")
    assert list(done.columns) == [*original.columns, "tmi_compensated"] and len(done) == len(original)


def test_command_line_keeps_given_keys(spark, tmp_path):
    """Keys that stand in the input file are part of the output."""
    from tests.flights import synthetic_flight

    frame = synthetic_flight()
    frame.insert(0, "flight_id", 7)
    frame.insert(1, "row_idx", range(len(frame)))
    frame.to_csv(tmp_path / "in.csv", index=False)
    (tmp_path / "c.json").write_text(json.dumps(DOC))
    assert main(["compensate", str(tmp_path / "in.csv"), "--coefficients", str(tmp_path / "c.json"), "--output", str(tmp_path / "o.csv")]) == 0
    done = pd.read_csv(tmp_path / "o.csv")
    assert list(done.columns) == [*frame.columns, "tmi_compensated"] and done["row_idx"].tolist() == list(range(len(frame)))


def test_switches_can_be_negated():
    from fluxspan.cli import parser

    args = parser().parse_args(["calibrate", "x.csv", "--use-cv", "--no-use-cv", "--no-use-ridge"])
    assert not args.use_cv and not args.use_ridge


def test_rows_are_numbered_in_reading_order(spark, tmp_path):
    from fluxspan.functions.ordered import with_keys

    frame = spark.range(1000).selectExpr("cast(id as double) as time").repartition(7)
    frame.write.parquet(str(tmp_path / "r"))
    read = spark.read.option("maxPartitionBytes", 1000).parquet(str(tmp_path / "r"))
    keyed = with_keys(read).orderBy("row_idx").toPandas()
    assert keyed["row_idx"].tolist() == list(range(1000)) and keyed["time"].tolist() == [r[0] for r in read.collect()]
    two = with_keys(read.withColumn("flight_id", F.lit(1) + (F.col("time") % 3).cast("int"))).toPandas()
    assert all(sorted(g["row_idx"]) == list(range(len(g))) for _, g in two.groupby("flight_id"))
    order = {t: i for i, t in enumerate(keyed["time"])}
    assert all([order[t] for t in g.sort_values("row_idx")["time"]] == sorted(order[t] for t in g["time"]) for _, g in two.groupby("flight_id"))


def test_command_line_errors(spark, tmp_path, capsys):
    assert main(["calibrate", "/no/such.csv", "--use-ridge", "--use-lasso"]) == 1
    assert main(["calibrate", "/no/such.csv", "--igrf-date", "yesterday"]) == 1
    assert main(["compensate", "/no/such.csv", "--coefficients", "/no/c.json"]) == 1
    assert capsys.readouterr().err.count("Error:") == 3


def test_strict_reading_keeps_integers(spark, tmp_path):
    (tmp_path / "i.csv").write_text("time,lat,lon,alt,B_total,B_x,B_y,B_z\n0,1,1,1,5,1,1,1\n1,1,1,1,5,1,1,1\n")
    from fluxspan.operators.validate import validate_dataframe

    assert validate_dataframe(read_csv(spark, str(tmp_path / "i.csv"))).count() == 2
    with pytest.raises(ValueError, match="double"):
        validate_dataframe(read_csv(spark, str(tmp_path / "i.csv"), strict=True))
