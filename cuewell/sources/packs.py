"""Fact packs: plain lines with scope headings, or JSON lines; reading and writing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

HEADING = r"^#\s*scope:\s*(\S+)\s*$"


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, text): every line with its place in its file, whatever the splits."""
    raw = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value")
    lines = raw.select("file", F.posexplode(F.split(F.regexp_replace("value", "^﻿", ""), "\r?\n")).alias("line", "text"))
    return lines.where("text <> ''")


def parse(lines: DataFrame, default_scope: str = "default") -> DataFrame:
    """(scope, file, line, t, key) of a pack's facts; headings carry forward, control characters reject a line."""
    kind = F.when(F.col("text").rlike(r"^\s*\{"), "json").when(F.col("text").rlike("^#"), "note").otherwise("fact")
    df = lines.withColumns({"kind": kind, "head": F.nullif(F.regexp_extract("text", HEADING, 1), F.lit(""))})
    w = Window.partitionBy("file").orderBy("line")
    df = df.withColumn("open", F.last("head", ignorenulls=True).over(w))
    field = lambda *names: F.coalesce(*[F.get_json_object("text", f"$.{n}") for n in names])
    t = F.when(F.col("kind") == "json", field("fact", "text")).otherwise(F.trim("text"))
    scope = F.coalesce(F.when(F.col("kind") == "json", field("scope", "id")), "open", F.lit(default_scope))
    out = df.where("kind <> 'note'").select(scope.alias("scope"), "file", "line", t.alias("t"), F.when(F.col("kind") == "json", field("key")).alias("key"))
    return out.where(F.col("t").isNotNull() & (F.trim("t") != "") & ~F.col("t").rlike(r"[\x00-\x08\x09\x0A-\x1F]"))


def import_pack(lines: DataFrame, known: DataFrame | None = None, dedup: bool = True, only_new_scopes: bool = False) -> DataFrame:
    """Facts of a pack, each once per scope; optionally only for scopes that hold nothing yet."""
    df = parse(lines)
    if dedup:
        df = df.withColumn("r", F.row_number().over(Window.partitionBy("scope", "t").orderBy("file", "line"))).where("r = 1").drop("r")
    if known is not None and only_new_scopes:
        df = df.join(known.select("scope").distinct(), "scope", "left_anti")
    return df


def import_into(facts: DataFrame, pack: DataFrame, dedup: bool = True, replace: bool = False) -> DataFrame:
    """Facts after a parsed pack: its facts follow those of their scope, or with replace take their place.

    With dedup, texts that a scope already holds are not written again.
    """
    from ..operators.encode import encode
    from ..operators.store import FACT, append, drop_known, renumber, replace_scopes

    held = encode(pack).select("scope", "file", "line", "t", "key")
    fresh = held if replace or not dedup else drop_known(held, facts, 1 << 62)
    w = Window.partitionBy("scope").orderBy("file", "line")
    new = fresh.select("scope", (F.row_number().over(w) - 1).alias("idx"), "t", F.lit(1.0).alias("strength"), "key")
    return replace_scopes(facts, new) if replace else append(renumber(facts.select(FACT)), new)


def export_pack(facts: DataFrame) -> DataFrame:
    """(scope, text): one pack per scope, JSON lines where a heading can't name the scope safely."""
    safe = F.col("scope").rlike(r"^\S+$")
    line = F.when(safe, F.col("t")).otherwise(F.to_json(F.struct("scope", F.col("t").alias("fact"))))
    by = facts.groupBy("scope").agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", line.alias("l")))), lambda x: x["l"]).alias("ls"))
    head = F.when(safe, F.concat(F.lit("# scope: "), "scope", F.lit("\n"))).otherwise("")
    return by.select("scope", F.concat(head, F.array_join("ls", "\n")).alias("text"))


def read_tsv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", schema=schema, quote="")
