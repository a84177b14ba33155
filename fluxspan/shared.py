"""Session helpers used by several operators."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the test tables, by name."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder the session names in ``spark.checkpoint.dir``.  A local
    session without one gets a temporary folder; a cluster must name a shared one."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="fluxspan-checkpoint-")
    sc.setCheckpointDir(folder)


def checkpointed(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the reliable checkpoint folder and cut its lineage."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def overlapping_chunks(position, size: int, halo: int):
    """Array of the chunk numbers that must see a row at ``position``.

    A row belongs to ``floor(position / size)``; it is also handed to the
    neighbouring chunk when it lies within ``halo`` of the border.  Needs
    ``halo <= size``.
    """
    own = F.floor(position / F.lit(size)).cast("bigint")
    offset = position - own * F.lit(size)
    return F.array_compact(
        F.array(
            own,
            F.when(offset < halo, own - 1),
            F.when(offset >= size - halo, own + 1),
        )
    )


def spread(df: DataFrame, key: str) -> DataFrame:
    """Rows dealt over more tasks, where a small input has fewer partitions than
    the cluster has cores; larger inputs stay as they are read, unshuffled."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(3 * cores, key) if df.rdd.getNumPartitions() < 2 * cores else df
