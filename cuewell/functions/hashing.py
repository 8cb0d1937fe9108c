"""64-bit FNV-1a hashes of strings, whole Arrow batches at a time."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as T

# The prime and the two bases in use, one for fact identities, one for words and samples.
PRIME = 0x100000001B3
FACT_BASIS, WORD_BASIS = 0xCBF29CE484222325, 1469598103934665603


def fnv(values: list[bytes], basis: int = WORD_BASIS) -> np.ndarray:
    """The hash of each byte string, place by place over all strings that reach so far."""
    sizes = np.array([len(v) for v in values], np.int64)
    data = np.frombuffer(b"".join(values), np.uint8).astype(np.uint64)
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]) if len(values) else np.zeros(0, np.int64)
    out = np.full(len(values), basis, np.uint64)
    live = np.argsort(-sizes, kind="stable")
    for k in range(int(sizes.max(initial=0))):
        live = live[: int(np.searchsorted(-sizes[live], -k, "left"))]
        out[live] = (out[live] ^ data[starts[live] + k]) * np.uint64(PRIME)
    return out


def _hex(basis: int):
    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        known = s.dropna()
        return pd.Series([f"{int(h):016x}" for h in fnv([x.encode() for x in known], basis)], index=known.index, dtype=object).reindex(s.index)

    return run


def fact_key(text: Column) -> Column:
    """Identity of a fact across formatting: 16 hex digits over its normalised words."""
    return _hex(FACT_BASIS)(F.array_join(T.norm_words(text), " "))


def sampled(text: Column) -> Column:
    """A sixteenth of all texts, the same ones everywhere: those whose hash ends in four zero bits."""
    return F.right(_hex(WORD_BASIS)(text), F.lit(1)) == "0"
