"""Tables and checkpoints."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_ready(spark: SparkSession) -> None:
    """Use the shared folder that the session names; a temporary one only where none is named and all runs on one machine, as in tests."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
    sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="arcspan-checkpoint-"))


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: survives the loss of executors, unlike a local one."""
    checkpoint_ready(df.sparkSession)
    return df.checkpoint(eager=True)


def not_blank(column) -> F.Column:
    """False for null, empty and only-space strings."""
    return F.coalesce(F.trim(column) != "", F.lit(False))
