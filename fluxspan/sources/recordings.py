"""Reading and writing recordings, coefficient documents and reports."""

from __future__ import annotations

import json
import math
import shutil
from collections.abc import Callable
from pathlib import Path
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fluxspan.functions.ordered import with_keys
from fluxspan.operators.calibrate import CalibrationResult
from fluxspan.schema import FLIGHT, N_TERMS, OPTIONAL_DOUBLES, REQUIRED_COLUMNS, ROW


def csv_columns(spark: SparkSession, path: str) -> list[str]:
    """Column names in the header of a CSV recording."""
    return spark.read.csv(path, header=True).columns


def read_csv(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """One recording from CSV.  The known columns are read as double; ``strict``
    infers types instead, so whole-number columns come as integers and fail
    validation.  Rows are numbered in file order."""
    if strict:
        return with_keys(spark.read.csv(path, header=True, inferSchema=True))
    names = csv_columns(spark, path)
    doubles = {*REQUIRED_COLUMNS, *OPTIONAL_DOUBLES}
    schema = T.StructType([T.StructField(n, T.DoubleType() if n in doubles else T.StringType()) for n in names])
    return with_keys(spark.read.csv(path, header=True, schema=schema))


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return with_keys(spark.read.parquet(path))


def write_csv(df: DataFrame, path: str, columns: list[str] | None = None, single: bool = False) -> None:
    """CSV with header of ``columns`` (all by default).  ``single`` gives one file
    named ``path`` in the order of the recording, which is what the command line
    writes: one recording passes through one task, not through the driver."""
    columns = columns or df.columns
    if not single:
        df.select(*columns).write.mode("overwrite").csv(path, header=True)
        return
    folder = Path(f"{path}.parts")
    df.orderBy(FLIGHT, ROW).select(*columns).coalesce(1).write.mode("overwrite").csv(folder.absolute().as_uri(), header=True)
    shutil.move(next(folder.glob("part-*.csv")), path)
    shutil.rmtree(folder)


def coefficient_document(result: CalibrationResult, model_terms: str) -> dict:
    return {
        "model_terms": model_terms,
        "coefficients": [float(c) for c in result.coefficients],
        "n_terms": int(result.n_terms),
        "condition_number": float(result.condition_number),
        "selected_alpha": result.selected_alpha,
        "effective_dof": result.effective_dof,
        "singular_values": [float(s) for s in result.singular_values],
    }


def write_coefficients(result: CalibrationResult, model_terms: str, path: str) -> None:
    Path(path).write_text(json.dumps(coefficient_document(result, model_terms), indent=2))


def _number(x) -> bool:
    return isinstance(x, (int, float)) and not isinstance(x, bool)


def _finite(x) -> bool:
    return _number(x) and math.isfinite(x)


def _list_of(kind):
    return lambda v: isinstance(v, list) and all(map(kind, v))


class _Field(NamedTuple):
    """What one key of a coefficient document must hold."""

    wanted: str
    holds: Callable[[object], bool]
    required: bool = True


class _Agreement(NamedTuple):
    """What keys that are sound by themselves must have in common."""

    keys: tuple[str, ...]
    holds: Callable[..., bool]
    says: Callable[..., str]


_FIELDS = {
    "model_terms": _Field(f"one of the models {', '.join(N_TERMS)}", lambda v: isinstance(v, str) and v in N_TERMS),
    "coefficients": _Field("a list of numbers", _list_of(lambda x: isinstance(x, (int, float)))),
    "n_terms": _Field("an integer", lambda v: type(v) is int),
    "condition_number": _Field("a finite number", _finite),
    "singular_values": _Field("a list of finite numbers", _list_of(_finite), required=False),
}
_AGREEMENTS = (
    _Agreement(("n_terms", "model_terms"), lambda n, m: n == N_TERMS[m], lambda n, m: f"'n_terms' is {n}, but model {m!r} has {N_TERMS[m]} terms"),
    _Agreement(("n_terms", "coefficients"), lambda n, c: n == len(c), lambda n, c: f"'n_terms' is {n}, but there are {len(c)} coefficients"),
    _Agreement(("n_terms", "singular_values"), lambda n, s: n == len(s), lambda n, s: f"'n_terms' is {n}, but there are {len(s)} singular_values"),
)


def validate_coefficients(data: object) -> dict:
    """The document itself, or one ``ValueError`` with all that is wrong in it.

    Every key is held against its line in ``_FIELDS``; then the lines of
    ``_AGREEMENTS`` are applied to the keys that passed.  Further keys are free.
    """
    faults = []
    if isinstance(data, dict):
        sound = {k: data[k] for k, f in _FIELDS.items() if k in data and f.holds(data[k])}
        for key, field in _FIELDS.items():
            if key in data and key not in sound:
                faults.append(f"{key!r} takes {field.wanted}; found {data[key]!r}")
            elif key not in data and field.required:
                faults.append(f"{key!r} is missing")
        for rule in _AGREEMENTS:
            if all(k in sound for k in rule.keys) and not rule.holds(*(own := [sound[k] for k in rule.keys])):
                faults.append(rule.says(*own))
    else:
        faults.append(f"a JSON object is needed at the root; found a {type(data).__name__}")
    if faults:
        raise ValueError("unusable coefficient document: " + "; ".join(faults))
    return data


def read_coefficients(path: str) -> tuple[CalibrationResult, str]:
    """Result (without residuals) and model of a coefficient document."""
    data = validate_coefficients(json.loads(Path(path).read_text()))
    sigma = data.get("singular_values")
    sigma = np.full(data["n_terms"], np.nan) if sigma is None else np.array(sigma, float)
    result = CalibrationResult(np.array(data["coefficients"], float), None, float(data["condition_number"]), sigma, data["n_terms"], data.get("selected_alpha"), data.get("effective_dof"))
    return result, data["model_terms"]


def report_rows(fom: DataFrame) -> DataFrame:
    """Report rows as JSON texts, for large numbers of flights."""
    return fom.select(F.to_json(F.struct(*fom.columns)).alias("report"))
