"""Learned models as tables in a folder: saved when they changed, read when they are first asked for.

Word vectors, topic counts, trust ledgers and class moments are DataFrames or become some; a model that
was never saved is None, and callers go on without it.
"""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MARK = "current"


def save(df: DataFrame, path: str) -> None:
    """Writes a model beside the last one, then points to it: a reader sees the old or the new, never half."""
    spark, name = df.sparkSession, uuid.uuid4().hex
    df.write.parquet(f"{path}/{name}")
    last = [r["n"] for r in _marks(spark, path)]
    spark.createDataFrame([(max(last, default=0) + 1, name)], "n long, name string").coalesce(1).write.mode("append").json(f"{path}/{MARK}")


def _exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)


def _marks(spark: SparkSession, path: str) -> list:
    return spark.read.schema("n long, name string").json(f"{path}/{MARK}").collect() if _exists(spark, f"{path}/{MARK}") else []


def load(spark: SparkSession, path: str) -> DataFrame | None:
    """The model saved last, or None."""
    marks = _marks(spark, path)
    return spark.read.parquet(f"{path}/{max(marks)['name']}") if marks else None


def save_if_changed(df: DataFrame, path: str) -> bool:
    """Saves a model whose rows differ from the one saved last; whether it did."""
    old = load(df.sparkSession, path)
    if old is not None and old.columns == df.columns:
        sums = lambda x: x.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64(*x.columns)), F.sum(F.xxhash64(*x.columns).cast("decimal(38,0)"))).first()
        if sums(old) == sums(df):
            return False
    save(df, path)
    return True


def moments_table(spark: SparkSession, moments: dict, second) -> DataFrame:
    """Class moments as rows: (class, weight, n, sum), the pooled second moment under a null class."""
    rows = [(c, float(w), int(n), [float(v) for v in s]) for c, (w, n, s) in moments.items()]
    if second is not None:
        rows.append((None, 0.0, 0, np.asarray(second).ravel().tolist()))
    return spark.createDataFrame(rows, "class string, weight double, n long, sum array<double>")


def moments_of(table: DataFrame):
    """Class moments from their rows."""
    rows = table.collect()  # a row a class
    second = next((np.array(r["sum"]) for r in rows if r["class"] is None), None)
    if second is not None:
        d = int(round(len(second) ** 0.5))
        second = second.reshape(d, d)
    return {r["class"]: (r["weight"], r["n"], np.array(r["sum"])) for r in rows if r["class"] is not None}, second


def classes(moments: dict) -> list[tuple[str, float]]:
    """Observed classes with their effective weights, by name."""
    return sorted((c, w) for c, (w, _, _) in moments.items())
