"""Consecutive numbers over a whole table without gathering it in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .lineage import cut


def numbered(df: DataFrame, order: list[str], name: str = "n") -> DataFrame:
    """Rows with their place, from 1, in the order of some columns.

    Rows are dealt by ranges of the order; a partition counts from what stands before it.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut(df.repartitionByRange(parts, *order).withColumn("_p", F.spark_partition_id()))
    sizes = {r["_p"]: r["k"] for r in ranged.groupBy("_p").agg(F.count(F.lit(1)).alias("k")).collect()}  # a row a partition
    base, before = [], 0
    for p in sorted(sizes):
        base += [F.lit(p), F.lit(before)]
        before += sizes[p]
    if not base:
        return df.withColumn(name, F.lit(0).cast("long"))
    own = F.row_number().over(Window.partitionBy("_p").orderBy(*order))
    return ranged.withColumn(name, (own + F.element_at(F.create_map(*base), F.col("_p"))).cast("long")).drop("_p")
