"""Facts to episodes: index keys, value candidates and head of every fact, in one pass over its tokens.

Whatever depends on the fact alone is worked out here, once: each candidate carries its stem, its
place, whether it is a number and the phrase it grows to, so that recall only compares.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as t

from ..functions import analysis


def _with(df: DataFrame, schema: str, text_col: str, make) -> DataFrame:
    """The frame's own columns and those that make(batch, place of the text) adds, over Arrow batches."""
    added = t.StructType.fromDDL(schema)
    own = [f for f in df.schema.fields if f.name not in added.fieldNames()]
    names = [f.name for f in own] + added.fieldNames()
    at = [f.name for f in own].index(text_col)

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays(make(b, at), names=names)

    return df.select([f.name for f in own]).mapInArrow(run, t.StructType([*own, *added.fields]))


def encode(facts: DataFrame, text_col: str = "t") -> DataFrame:
    """Adds tok, tok_stems, c, cand, v, raw, s, pos, roots, head and self_flag; rows that hold no fact go.

    A null text holds no fact.
    """
    return _with(facts, analysis.EPISODE, text_col, analysis.episodes_of)


def cues(queries: DataFrame, expand: bool = True, text_col: str = "query") -> DataFrame:
    """Adds q (content words), cue (stems) and the query's flags; queries without content go."""
    return _with(queries, analysis.CUE, text_col, lambda b, at: analysis.cues_of(b, at, expand))


def pick_value(df: DataFrame, cue: str, want_number: str) -> DataFrame:
    """Adds value and echo: the candidate that answers a cue column; echo when the cue holds them all.

    Numbers come nearest to a cue word when a number is wanted; else candidates after the last cue
    word are preferred.
    """
    at = F.filter(F.transform("tok_stems", lambda s, i: F.when(F.array_contains(cue, s), i)), lambda i: i.isNotNull())
    df = df.withColumns({"_at": at, "_pool": F.filter("cand", lambda x: ~F.array_contains(cue, x["st"]))})
    numbers = F.filter("_pool", lambda x: x["num"])
    df = df.withColumn("_pool", F.when(F.col(want_number) & (F.size(numbers) > 0), numbers).otherwise(F.col("_pool")))
    gap = lambda p, q: F.struct(F.abs(p - q).alias("d"), F.when(p <= q, 0).otherwise(1).alias("side"))
    near = F.array_sort(F.transform("_pool", lambda x, i: F.struct(F.array_min(F.transform("_at", lambda q: gap(x["p"], q))).alias("d"), i.alias("i"), x["x"].alias("x"))))
    after = F.filter("_pool", lambda x: x["p"] > F.array_max("_at"))
    several = (F.size("_at") > 0) & (F.size("_pool") > 1)
    best = (
        F.when(several & F.col(want_number), F.get(near, F.lit(0))["x"])
        .when(several & ~F.col(want_number) & (F.size(after) > 0), F.get(after, F.lit(0))["x"])
        .otherwise(F.get("_pool", F.lit(0))["x"])
    )
    df = df.withColumn("_best", best)
    return df.withColumns({"value": F.coalesce("_best", F.get("cand", F.lit(0))["x"]), "echo": F.col("_best").isNull()}).drop("_at", "_pool", "_best")
