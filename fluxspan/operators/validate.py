"""Input contract: all checks in one aggregate, all errors in one message."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fluxspan.functions.ordered import with_keys, with_neighbours
from fluxspan.schema import COL_BTOTAL, COL_BX, COL_BY, COL_BZ, COL_TIME, FLIGHT, IMU_COLUMNS, REQUIRED_COLUMNS


def check_type(df) -> None:
    if not (hasattr(df, "schema") and hasattr(df, "select") and hasattr(df, "sparkSession")):
        raise TypeError(f"expected a Spark DataFrame, got {type(df).__name__}")


def validation_counts(df: DataFrame) -> DataFrame:
    """One row of counts: rows, nulls per column, non-positive fields, times that
    don't increase, zero fluxgate vectors.  NaN is not null and passes."""
    keyed = with_keys(df)
    present = [c for c in (*REQUIRED_COLUMNS, *IMU_COLUMNS) if c in df.columns]
    if COL_TIME in df.columns:
        keyed = with_neighbours(keyed, [FLIGHT], 1, 0, lambda x, w: x.withColumn("_step", F.col(COL_TIME) - F.lag(COL_TIME).over(w)))
    aggs = [F.count("*").alias("n_rows"), *[F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in present]]
    aggs.append((F.count_if(F.col(COL_BTOTAL) <= 0) if COL_BTOTAL in df.columns else F.lit(0)).cast("bigint").alias("not_positive"))
    aggs.append((F.count_if(F.col("_step") <= 0) if COL_TIME in df.columns else F.lit(0)).cast("bigint").alias("not_increasing"))
    vector = [c for c in (COL_BX, COL_BY, COL_BZ) if c in df.columns]
    zero = F.count_if(sum((F.col(c) * F.col(c) for c in vector), F.lit(0.0)) <= 0) if len(vector) == 3 else F.lit(0)
    return keyed.agg(*aggs, zero.cast("bigint").alias("zero_vector"))


def validate_dataframe(df: DataFrame) -> DataFrame:
    """``df`` itself if it keeps the contract; otherwise one ``ValueError`` that
    lists every violation (``TypeError`` for something that is no DataFrame)."""
    check_type(df)
    errors = []
    missing = [c for c in REQUIRED_COLUMNS if c not in df.columns]
    if missing:
        errors.append(f"Missing required columns: {missing}.")
    typed = [c for c in (*(() if missing else REQUIRED_COLUMNS), *IMU_COLUMNS) if c in df.columns]
    wrong_type = [c for c in typed if not isinstance(df.schema[c].dataType, T.DoubleType)]
    errors += [f"Column {c!r} must be double, got {df.schema[c].dataType.simpleString()}." for c in wrong_type]
    numeric = [c for c in df.columns if isinstance(df.schema[c].dataType, T.NumericType)]
    counts = validation_counts(df.select(*[c for c in df.columns if c in numeric or c not in (*REQUIRED_COLUMNS, *IMU_COLUMNS)])).first().asDict()
    if counts["n_rows"] == 0:
        errors.append("DataFrame is empty.")
    nulls = [c for c in typed if counts.get(f"null_{c}", 0)]
    errors += [f"Column {c!r} has {counts[f'null_{c}']} null values." for c in nulls]
    if counts["not_positive"] and COL_BTOTAL not in (*wrong_type, *nulls):
        errors.append(f"Column {COL_BTOTAL!r} must be positive; {counts['not_positive']} values are not.")
    if counts["not_increasing"]:
        errors.append(f"Column {COL_TIME!r} must be strictly increasing; {counts['not_increasing']} steps are not.")
    if errors:
        raise ValueError("DataFrame validation failed:\n" + "\n".join(f"  - {e}" for e in errors))
    return df
