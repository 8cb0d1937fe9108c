"""Unique row keys for tables whose ids may be null or repeated."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lineage import cut


def keyed(rows: DataFrame, id_col: str = "doc_id") -> tuple[DataFrame, DataFrame | None]:
    """The rows with a long ``key`` that no other row has, and (key, id) of the rows whose key isn't their id.

    An id that one row has is that row's key.  Rows whose id is null or repeated get keys beyond all
    ids, written once, so that they stay the same when a task runs again.  Where there are no such
    rows the second is None, and finding that out moves ids only.
    """
    ids = rows.select(F.col(id_col).cast("long").alias("_i"))
    again = cut(ids.groupBy("_i").agg(F.count(F.lit(1)).alias("_n")).where("_i IS NULL OR _n > 1").select("_i"))
    if again.isEmpty():
        return rows.withColumn("key", F.col(id_col).cast("long")), None
    same = F.col(id_col).cast("long").eqNullSafe(F.col("_i"))
    plain = rows.join(again, same, "left_anti").withColumn("key", F.col(id_col).cast("long"))
    odd = cut(rows.join(again, same, "left_semi").withColumn("key", F.monotonically_increasing_id()))
    most = odd.agg(F.max("key")).first()[0]
    lo, hi = ids.agg(F.min("_i"), F.max("_i")).first()
    first = 0 if hi is None else hi + 1
    if first + most >= 2**63:
        first = lo - 1 - most
    if first < -(2**63):
        raise ValueError("ids leave no room for keys of the rows without one of their own")
    odd = odd.withColumn("key", F.col("key") + F.lit(first).cast("long"))
    return plain.unionByName(odd), odd.select("key", F.col(id_col).cast("long").alias(id_col))


def named(out: DataFrame, names: DataFrame | None, id_col: str = "doc_id") -> DataFrame:
    """Rows with a ``key``, given their ids in its place."""
    if names is None:
        return out.withColumnRenamed("key", id_col)
    marked = names.select("key", F.col(id_col).alias("_i"), F.lit(True).alias("_odd"))
    both = out.join(marked, "key", "left")
    return both.select(F.when(F.col("_odd"), F.col("_i")).otherwise(F.col("key")).alias(id_col), *[c for c in out.columns if c != "key"])
