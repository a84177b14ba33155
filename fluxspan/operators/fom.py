"""Figure-of-merit report: rms before and after, improvement ratio."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fluxspan.operators.calibrate import CalibrationResult
from fluxspan.schema import COL_DELTA_B


@dataclass(frozen=True)
class ManeuverStats:
    rms_before: float
    rms_after: float
    n_samples: int


@dataclass(frozen=True)
class HeadingStats:
    rms_before: float
    rms_after: float
    n_samples: int


@dataclass(frozen=True)
class FomReport:
    per_maneuver: dict[str, ManeuverStats]
    per_heading: dict[str, HeadingStats]
    improvement_ratio: float

    def to_json(self) -> str:
        return json.dumps(asdict(self))


def fom_table(residuals: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Statistics by maneuver, by heading and overall (both null), per ``keys``,
    from one scan with grouping sets."""
    rms = lambda c: F.sqrt(F.avg(F.col(c) * F.col(c)))
    m, h = F.col("seg_maneuver"), F.col("seg_heading")
    rest = [F.col(k) for k in keys]
    grouped = residuals.groupingSets([[*rest, m], [*rest, h], rest], *rest, m, h)
    out = grouped.agg(
        rms(COL_DELTA_B).alias("rms_before"),
        rms("residual").alias("rms_after"),
        F.count("*").alias("n_samples"),
        F.stddev_pop(COL_DELTA_B).alias("_before"),
        F.stddev_pop("residual").alias("_after"),
    )
    ratio = F.when(F.col("_after") == 0, F.lit(float("inf"))).otherwise(F.col("_before") / F.col("_after"))
    return out.select(*keys, m.alias("maneuver"), h.alias("heading"), "rms_before", "rms_after", "n_samples", ratio.alias("improvement_ratio"))


def compute_fom_report(df: DataFrame, segments: DataFrame, result: CalibrationResult) -> FomReport:
    """The report of one calibration; groups appear in the order of their first segment."""
    if COL_DELTA_B not in df.columns:
        raise ValueError(f"column {COL_DELTA_B!r} is required")
    listed = segments.groupBy("maneuver", "heading").agg(F.sum(F.col("end_idx") - F.col("start_idx")).alias("n"), F.min(F.struct("flight_id", "seg_ord")).alias("at")).collect()
    if not listed:
        raise ValueError("segments must be non-empty")
    rows = fom_table(result.residuals).collect()
    total = next((r["n_samples"] for r in rows if r["maneuver"] is None and r["heading"] is None), 0)
    if total != (expected := sum(r["n"] for r in listed)):
        raise ValueError(f"the result has {total} residuals, the segments have {expected} rows")
    first: dict = {}
    for r in listed:
        for group in (r["maneuver"], r["heading"]):
            first[group] = min(first.get(group, r["at"]), r["at"])
    rows.sort(key=lambda r: first.get(r["maneuver"] or r["heading"], (-1,)))
    stat = lambda kind, r: kind(r["rms_before"], r["rms_after"], r["n_samples"])
    ratio = next(r["improvement_ratio"] for r in rows if r["maneuver"] is None and r["heading"] is None)
    return FomReport({r["maneuver"]: stat(ManeuverStats, r) for r in rows if r["maneuver"]}, {r["heading"]: stat(HeadingStats, r) for r in rows if r["heading"]}, ratio)
