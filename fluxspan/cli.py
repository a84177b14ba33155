"""Command line: ``python -m fluxspan calibrate|compensate``."""

from __future__ import annotations

import argparse
import datetime as dt
import sys

from pyspark.sql import SparkSession

from fluxspan.config import PipelineConfig
from fluxspan.operators.baseline import compute_interference
from fluxspan.operators.calibrate import calibrate
from fluxspan.operators.fom import compute_fom_report
from fluxspan.operators.score import compensate
from fluxspan.operators.segments import segment_fom, steady_rows
from fluxspan.operators.validate import validate_dataframe
from fluxspan.schema import COL_TMI_COMPENSATED
from fluxspan.sources.recordings import csv_columns, read_coefficients, read_csv, write_coefficients, write_csv


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="fluxspan")
    commands = top.add_subparsers(dest="command", required=True)
    c = commands.add_parser("calibrate", help="fit coefficients from a calibration flight")
    c.add_argument("input_csv")
    c.add_argument("--output", default="coefficients.json")
    c.add_argument("--model-terms", choices=list("abcd"), default="c")
    c.add_argument("--earth-field-method", choices=["igrf", "steady_mean"], default="igrf")
    c.add_argument("--igrf-date")
    c.add_argument("--igrf-coefficients", help="public SHC coefficient file")
    c.add_argument("--segment-label-col")
    for flag in ("use-ridge", "use-lasso", "use-elastic-net", "use-cv", "auto-regularize"):
        c.add_argument(f"--{flag}", action=argparse.BooleanOptionalAction, default=False)
    for name, default in (("ridge-alpha", 1e-3), ("lasso-alpha", 1e-3), ("elastic-net-alpha", 1e-3), ("elastic-net-l1-ratio", 0.5)):
        c.add_argument(f"--{name}", type=float, default=default)
    c.add_argument("--cv-folds", type=int, default=5)
    k = commands.add_parser("compensate", help="apply coefficients to a recording")
    k.add_argument("input_csv")
    k.add_argument("--coefficients", required=True)
    k.add_argument("--output", default="compensated.csv")
    return top


def _calibrate(args: argparse.Namespace) -> None:
    try:
        date = dt.date.fromisoformat(args.igrf_date) if args.igrf_date else dt.date.today()
    except ValueError:
        raise ValueError(f"--igrf-date takes a date like 2024-01-31, not {args.igrf_date!r}") from None
    names = ("model_terms", "earth_field_method", "segment_label_col", "use_ridge", "ridge_alpha", "use_lasso", "lasso_alpha", "use_elastic_net", "elastic_net_alpha", "elastic_net_l1_ratio", "use_cv", "cv_folds", "auto_regularize")
    config = PipelineConfig(igrf_date=date, **{n: getattr(args, n) for n in names})  # before the file is read
    spark = SparkSession.builder.getOrCreate()
    df = validate_dataframe(read_csv(spark, args.input_csv, strict=True))
    segments = segment_fom(df, config)
    mask = None
    if config.earth_field_method == "steady_mean":
        df, mask = steady_rows(df, segments), "steady"
    df = compute_interference(df, config, mask, args.igrf_coefficients)
    result = calibrate(df, segments, config)
    print(compute_fom_report(df, segments, result).to_json())
    write_coefficients(result, config.model_terms, args.output)


def _compensate(args: argparse.Namespace) -> None:
    spark = SparkSession.builder.getOrCreate()
    given = csv_columns(spark, args.input_csv)
    df = validate_dataframe(read_csv(spark, args.input_csv, strict=True))
    result, model = read_coefficients(args.coefficients)
    write_csv(compensate(df, result, PipelineConfig(model_terms=model)), args.output, list(dict.fromkeys([*given, COL_TMI_COMPENSATED])), single=True)


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    try:
        {"calibrate": _calibrate, "compensate": _compensate}[args.command](args)
    except Exception as e:  # the contract: any failure is one line and exit code 1
        print(f"Error: {e}", file=sys.stderr)
        return 1
    return 0
