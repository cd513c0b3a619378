"""Ranks within groups of any size, without a task that holds a whole group."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def rank_within(df: DataFrame, keys: list[str], order: list[str], ids: list[str], name: str = "rank") -> DataFrame:
    """Adds a rank from 0 within the keys: by the order columns, then by a hash of the ids, then by the ids.

    The rows are put into ranges of all of these columns, one shuffle, and sorted there; a range knows its rows of a key by
    their running numbers, and one row a key and range tells how many come before. So neither a hot key nor equal values nor
    values that are all different come together in one task. Nulls in keys or order make a group like any value. Rows that
    agree in all of these columns share out their ranks in any way. An empty frame stays empty.
    """
    by = [F.col(c).asc_nulls_first() for c in [*keys, *order]] + [F.xxhash64(*ids).asc()] + [F.col(c).asc_nulls_first() for c in ids]
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(parts, *by).sortWithinPartitions(*by).withColumns({"__at": F.monotonically_increasing_id(), "__part": F.spark_partition_id()}).persist(StorageLevel.MEMORY_AND_DISK)
    counts = ranged.groupBy(*keys, "__part").agg(F.count("*").alias("__n"), F.min("__at").alias("__first"))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shift = counts.select(*[F.col(c).alias(f"__k{k}") for k, c in enumerate(keys)], F.col("__part").alias("__p"), (before - F.col("__first")).alias("__shift"))
    same = ranged["__part"] == shift["__p"]
    for k, c in enumerate(keys):
        same = same & ranged[c].eqNullSafe(shift[f"__k{k}"])
    return ranged.join(shift, same).withColumn(name, F.col("__at") + F.col("__shift")).select(*df.columns, name)
