"""Encrypted values found by keyed hashes of their cue's stems; neither key nor text is stored."""

from __future__ import annotations

import base64
import hashlib
import hmac

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

LEAST_COVER = 0.5


def derive(secret: bytes, scope: str, purpose: str) -> bytes:
    """A 32-byte key of (secret, scope, purpose), extract-and-expand by HMAC-SHA256."""
    root = hmac.new(f"cuewell/{scope}".encode(), secret, hashlib.sha256).digest()
    return hmac.new(root, purpose.encode() + b"\x01", hashlib.sha256).digest()


def _hash_stems(secret: bytes):
    @F.pandas_udf("array<string>")
    def run(scope: pd.Series, stems: pd.Series) -> pd.Series:
        out = []
        for s, ws in zip(scope, stems, strict=True):
            key = derive(secret, s, "index")
            out.append([base64.b64encode(hmac.new(key, w.encode(), hashlib.sha256).digest()[:8]).decode() for w in ws])
        return pd.Series(out)

    return run


def _keys(df: DataFrame, secret: bytes) -> DataFrame:
    @F.pandas_udf("binary")
    def key(scope: pd.Series) -> pd.Series:
        return scope.map(lambda s: derive(secret, s, "value"))

    return df.withColumn("_key", key("scope"))


def put(rows: DataFrame, secret: bytes) -> DataFrame:
    """(scope, seq, phrase, value) to (scope, seq, idx, ct); phrases without content are refused."""
    df = rows.withColumn("st", T.cue(F.col("phrase"), False)).where(F.size("st") > 0)
    df = _keys(df, secret).withColumn("idx", _hash_stems(secret)("scope", "st"))
    ct = F.base64(F.aes_encrypt(F.col("value").cast("binary"), F.col("_key"), F.lit("GCM"), F.lit("DEFAULT"), F.lit("").cast("binary"), F.col("scope").cast("binary")))
    return df.select("scope", "seq", "idx", ct.alias("ct"))


def get(queries: DataFrame, store: DataFrame, secret: bytes) -> DataFrame:
    """(qid, scope, value): the latest entry whose stems the cue covers best, at least by half."""
    q = queries.withColumn("st", T.cue(F.col("query"), False)).where(F.size("st") > 0).withColumn("h", _hash_stems(secret)("scope", "st"))
    keyed = store.select("scope", "seq", "ct", F.size("idx").alias("n"), F.explode("idx").alias("x"))
    hits = q.select("qid", "scope", F.explode("h").alias("x")).join(keyed, ["scope", "x"]).groupBy("qid", "scope", "seq", "ct", "n").agg(F.count(F.lit(1)).alias("m"))
    best = hits.withColumn("cover", F.col("m") / F.col("n")).where(F.col("cover") >= LEAST_COVER).groupBy("qid", "scope").agg(F.max_by("ct", F.struct("cover", "seq")).alias("ct"))
    plain = F.aes_decrypt(F.unbase64("ct"), F.col("_key"), F.lit("GCM"), F.lit("DEFAULT"), F.col("scope").cast("binary")).cast("string")
    return _keys(best, secret).select("qid", "scope", plain.alias("value"))
