"""Capture: lines that keep arriving become facts of a scope."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..operators.encode import encode
from ..operators.store import DEDUP_WINDOW
from ..operators.vectors import train

MAX_LINE = 65536


def split_lines(text, limit: int = MAX_LINE):
    """Lines of a text column value, carriage returns dropped, overlong ones cut to pieces of limit."""
    lines = F.split(F.replace(text, F.lit("\r\n"), F.lit("\n")), "\n")
    pieces = lambda x: F.transform(F.sequence(F.lit(0), F.greatest(F.length(x) - 1, F.lit(0)), F.lit(limit)), lambda i: F.substring(x, i + 1, F.lit(limit)))
    return F.filter(F.flatten(F.transform(lines, pieces)), lambda x: x != "")


def line_stream(spark: SparkSession, folder: str, files_a_trigger: int = 1) -> DataFrame:
    """Lines of the text files that arrive in a folder, with their file and a time."""
    raw = spark.readStream.option("maxFilesPerTrigger", files_a_trigger).text(folder, wholetext=True)
    return raw.select(F.col("_metadata.file_path").alias("file"), F.posexplode(split_lines(F.col("value"))).alias("line", "text"))


def keep(lines: DataFrame, only: str | None = None, skip: str | None = None) -> DataFrame:
    """Lines that hold only and don't hold skip."""
    if only:
        lines = lines.where(F.contains("text", F.lit(only)))
    if skip:
        lines = lines.where(~F.contains("text", F.lit(skip)))
    return lines


def capture(
    lines: DataFrame, scope: str, table: str, checkpoint: str, dedup: bool = True, window: int | None = DEDUP_WINDOW, poll: str | None = None, models: str | None = None, tee: str | None = None
):
    """Starts a query that appends the facts of each batch of lines to a Parquet folder.

    With dedup a text that is among the last facts of the table (window; None: any) isn't stored again.
    poll ('300 milliseconds') keeps the query running; without it, it ends when all lines are read.
    models: a folder where word vectors learn from every batch.  tee: a folder that gets the lines as
    they came.  A batch is written under its number, so a batch that runs again after a failure replaces
    its own files and nothing is doubled or learned twice.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch = batch.persist()
        if tee:
            batch.select("file", "line", "text").write.mode("overwrite").parquet(f"{tee}/batch={number}")
        facts = encode(batch.select(F.lit(scope).alias("scope"), "file", "line", F.col("text").alias("t")))
        rows = facts.select("scope", "file", "line", "t")
        if dedup:
            rows = rows.withColumn("r", F.row_number().over(Window.partitionBy("scope", "t").orderBy("file", "line"))).where("r = 1").drop("r")
            if number:
                old = spark.read.schema("scope string, file string, line int, t string, batch long").parquet(table).where(F.col("batch") < number)
                if window is not None:
                    # The newest facts: batches from the last one back until they hold enough.
                    sizes = {r["batch"]: r["n"] for r in old.groupBy("batch").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a batch
                    first, held = number, 0
                    while held < window and first - 1 in range(min(sizes, default=0), number):
                        first -= 1
                        held += sizes.get(first, 0)
                    near = Window.partitionBy("scope").orderBy(F.desc("batch"), F.desc("file"), F.desc("line"))
                    old = old.where(F.col("batch") >= first).withColumn("r", F.row_number().over(near)).where(F.col("r") <= window)
                rows = rows.join(old.select("scope", "t").distinct(), ["scope", "t"], "left_anti")
        rows.select("scope", "file", "line", "t").write.mode("overwrite").parquet(f"{table}/batch={number}")
        if models:
            prose = rows.where(T.prose_like(F.col("t"))).select(F.col("t").alias("text"))
            train(prose).write.mode("overwrite").parquet(f"{models}/batch={number}")
        batch.unpersist()

    writer = lines.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=poll) if poll else writer.trigger(availableNow=True)).start()


def learned(spark: SparkSession, models: str) -> DataFrame:
    """(word, dim, val) of all batches of a capture: as if trained on their facts at once."""
    return spark.read.parquet(models).groupBy("word", "dim").agg(F.sum("val").alias("val")).where("val <> 0")


def dedup_stream(events: DataFrame, keys: list[str], time_col: str, delay: str = "1 hour") -> DataFrame:
    """A stream's rows once per key within a watermark; state older than the delay is dropped."""
    return events.withWatermark(time_col, delay).dropDuplicatesWithinWatermark(keys)
