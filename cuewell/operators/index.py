"""A stored inverted index: written once, grown by appending, read by recall without encoding facts again.

A folder holds three tables.  ``episodes`` and ``postings`` are dealt into buckets of the scope, postings
sorted by stem inside; ``counts`` has a row for each scope, stem and write, added up when read.  Appending
writes new files only.  A recall that names few scopes reads their buckets alone.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import recall

BUCKETS = 64


@dataclass(frozen=True)
class Index:
    """Tables that recall reads: episodes, (scope, stem, idx), (scope, stem, df) and (scope, n)."""

    episodes: DataFrame
    postings: DataFrame
    counts: DataFrame
    sizes: DataFrame

    @classmethod
    def of(cls, episodes: DataFrame) -> Index:
        """The index of episodes, worked out where it is read."""
        return cls(episodes, recall.postings(episodes), recall.document_counts(episodes), recall.sizes(episodes))


def _bucketed(df: DataFrame) -> DataFrame:
    return df.withColumn("bucket", F.pmod(F.xxhash64("scope"), F.lit(BUCKETS)).cast("int"))


def append(episodes: DataFrame, path: str) -> None:
    """Adds episodes, whose idx go on from what is stored, to the index in a folder."""
    posts = recall.postings(episodes)
    # Rebalanced: few files for small writes, while a large bucket is still split.
    _bucketed(episodes).hint("rebalance", "bucket").write.mode("append").partitionBy("bucket").parquet(f"{path}/episodes")
    _bucketed(posts).hint("rebalance", "bucket").sortWithinPartitions("bucket", "scope", "stem").write.mode("append").partitionBy("bucket").parquet(f"{path}/postings")
    df = recall.document_counts(episodes).select("scope", "stem", "df")
    n = recall.sizes(episodes).select("scope", F.lit("").alias("stem"), F.col("n").alias("df"))  # the empty stem stands for the scope
    _bucketed(df.unionByName(n)).hint("rebalance", "bucket").write.mode("append").partitionBy("bucket").parquet(f"{path}/counts")


def load(spark: SparkSession, path: str, scopes: list[str] | None = None) -> Index:
    """The index in a folder, for all scopes or a few."""

    def table(name: str) -> DataFrame:
        df = spark.read.parquet(f"{path}/{name}")
        if scopes is not None:
            wanted = spark.createDataFrame([(s,) for s in scopes], "scope string")
            buckets = [r["bucket"] for r in _bucketed(wanted).select("bucket").distinct().collect()]
            df = df.where(F.col("bucket").isin(buckets) & F.col("scope").isin(scopes))
        return df.drop("bucket")

    counts = table("counts")
    df = counts.where("stem <> ''").groupBy("scope", "stem").agg(F.sum("df").alias("df"))
    n = counts.where("stem = ''").groupBy("scope").agg(F.sum("df").alias("n"))
    return Index(table("episodes"), table("postings"), df, n)
