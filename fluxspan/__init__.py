"""fluxspan: a Spark-native engine for airborne magnetometer data.

Every transform takes and returns a lazy ``DataFrame``; only summaries whose
size is bounded by the model (never by the data) reach the driver.

The public names are looked up on first use, so that a Python worker loads only
the module it runs.
"""

from importlib import import_module

__version__ = "0.1.0"

_HOME = {
    "config": ("PipelineConfig",),
    "operators.validate": ("validate_dataframe", "validation_counts"),
    "operators.segments": ("Segment", "segments_frame", "segment_fom", "rows_in_segments", "steady_rows", "bin_centres_from_ref", "resolve_reference_heading", "assign_heading_bin"),
    "operators.baseline": ("compute_interference",),
    "operators.features": ("build_feature_matrix", "add_features"),
    "operators.linalg": ("compute_vif",),
    "operators.calibrate": ("CalibrationResult", "HeadingCalibrationResult", "AdaptiveCalibrationResult", "calibrate", "calibrate_per_heading", "calibrate_adaptive_maneuvers", "fit_models"),
    "operators.score": ("compensate", "compensate_heading_specific", "compensate_adaptive", "compensate_by_model"),
    "operators.fom": ("FomReport", "ManeuverStats", "HeadingStats", "compute_fom_report", "fom_table"),
    "operators.rls": ("RLSState", "initialize_rls", "update_rls", "update_rls_batch", "update_rls_by_flight", "rls_to_calibration_result"),
    "operators.nn": ("NNConfig", "PINNConfig", "NNCalibrationResult", "PINNCalibrationResult", "calibrate_nn", "predict_nn", "compensate_nn", "calibrate_pinn", "predict_pinn", "compensate_pinn"),
    "operators.spikes": ("implausible_readings",),
    "operators.regrid": ("regular_grid",),
    "sources.rejects": ("load_records",),
    "sources.recordings": ("read_csv", "read_parquet", "write_csv", "read_coefficients", "write_coefficients", "validate_coefficients"),
    "streaming.live": ("rls_stream", "compensate_stream"),
}
_WHERE = {name: module for module, names in _HOME.items() for name in names}


def __getattr__(name: str):
    if name in _WHERE:
        return getattr(import_module(f"fluxspan.{_WHERE[name]}"), name)
    if name.startswith("COL_") or name == "REQUIRED_COLUMNS":
        return getattr(import_module("fluxspan.schema"), name)
    raise AttributeError(f"module 'fluxspan' has no attribute {name!r}")


def __dir__() -> list[str]:
    return sorted([*globals(), *_WHERE, *(n for n in dir(import_module("fluxspan.schema")) if n.startswith("COL_"))])
