"""Operator 10: quality classifier, a factorisation machine in linear time.

Features are hashed words (each occurrence weighs 1 / words), one-hot bins of structure statistics
and of the text's length as metadata.  Every feature has a weight and a low-rank vector; all pairwise interactions
are scored at once as half of (the squared sum of vectors minus the sum of their squares).

Labels are learned from a bounded sample (``sample_rows``, lowest hashes first, so it is the same
for the same rows) of the labelled rows outside the held-out third; only that sample's sparse
features reach the driver.  Scoring is one pass over all whole texts, without a shuffle.

Null or empty text: no words, statistics of an empty text, scored like any other.  With no usable
label, or labels of one class, the score is that class's share (0.5 without labels).
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lineage import cut
from .textblocks import WORD_BYTES, blocks, lower_ascii, prefix_sums, span_hashes, word_spans

WORD_BITS = 14
N_WORDS = 1 << WORD_BITS
BINS = 16
RANK = 8
#: Structure statistics in feature order, each with the range its bins divide.
STATISTICS = {
    "log_words": (0.0, 10.0),
    "log_bytes": (0.0, 12.0),
    "mean_word": (0.0, 16.0),
    "symbols_per_word": (0.0, 2.0),
    "pipes_per_word": (0.0, 1.0),
    "digits_per_byte": (0.0, 0.4),
    "capitals_per_word": (0.0, 1.0),
    "stops_per_word": (0.0, 0.5),
    "distinct_share": (0.0, 1.0),
    "repeat_share": (0.0, 1.0),
    "lines_per_word": (0.0, 0.5),
    "short_share": (0.0, 1.0),
    "pair_distinct_share": (0.0, 1.0),
    "wide_per_byte": (0.0, 0.5),
}
N_FEATURES = N_WORDS + BINS * len(STATISTICS)


def _per_row(flags: np.ndarray, offs: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=sums[1:])
    return sums[offs[1:]] - sums[offs[:-1]]


def _distinct(keys: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Distinct keys of each row."""
    order = np.lexsort((keys, rows)) if len(keys) < 2 else np.argsort(keys ^ (rows.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), kind="stable")
    k, r = keys[order], rows[order]
    new = np.ones(len(k), bool)
    new[1:] = (k[1:] != k[:-1]) | (r[1:] != r[:-1])
    return np.bincount(r[new], minlength=n)


def features(data: np.ndarray, offs: np.ndarray):
    """(word features, row offsets into them, bins of the statistics: rows x statistics) of a block."""
    n = len(offs) - 1
    low = lower_ascii(data)
    starts, ends, rows = word_spans(low, offs, WORD_BYTES)
    keys = span_hashes(prefix_sums(low), starts, ends)
    word_rows = np.searchsorted(rows, np.arange(n + 1), "left")
    size = (offs[1:] - offs[:-1]).astype(np.float64)
    words = (word_rows[1:] - word_rows[:-1]).astype(np.float64)
    per = np.maximum(words, 1)
    nb = np.maximum(size, 1)
    flag = np.zeros(256, np.uint8)
    flag[list(b"#*$%&<>@~^=+_{}[]\\")] = 1
    flag[ord("|")] = 2
    flag[48:58] = 4
    flag[65:91] = 8
    flag[list(b".!?")] = 16
    flag[10] = 32
    flag[128:] = 64
    kind = flag[data]
    count = lambda bit: _per_row((kind & bit) > 0, offs)
    lens = (ends - starts).astype(np.float64)
    same = np.zeros(len(keys), bool)
    same[1:] = (keys[1:] == keys[:-1]) & (rows[1:] == rows[:-1])
    pair = keys.copy()
    pair[1:] ^= keys[:-1] * np.uint64(0x9E3779B97F4A7C15)
    values = [
        np.log1p(words),
        np.log1p(size),
        np.bincount(rows, weights=lens, minlength=n) / per,
        count(1) / per,
        count(2) / per,
        count(4) / nb,
        count(8) / per,
        count(16) / per,
        _distinct(keys, rows, n) / per,
        np.bincount(rows, weights=same, minlength=n) / per,
        count(32) / per,
        np.bincount(rows, weights=lens <= 3, minlength=n) / per,
        _distinct(pair, rows, n) / per,
        count(64) / nb,
    ]
    bins = np.empty((n, len(values)), np.int64)
    for k, (v, (lo, hi)) in enumerate(zip(values, STATISTICS.values(), strict=True)):
        bins[:, k] = N_WORDS + k * BINS + np.clip((np.nan_to_num(v) - lo) / (hi - lo) * BINS, 0, BINS - 1).astype(np.int64)
    return (keys >> np.uint64(64 - WORD_BITS)).astype(np.int64), word_rows, bins


def margins(model, word, word_rows, bins) -> np.ndarray:
    """Factorisation-machine score of each row, by the sum-of-squares identity."""
    w0, w, v = model
    n = len(bins)
    per = np.maximum(word_rows[1:] - word_rows[:-1], 1).astype(np.float64)

    def row_sums(x):
        out = np.zeros((len(word) + 1, *x.shape[1:]))
        np.cumsum(x, axis=0, out=out[1:])
        return out[word_rows[1:]] - out[word_rows[:-1]]

    linear = w0 + row_sums(w[word]) / per + w[bins].sum(1)
    half = np.zeros(n)
    squares = (v**2).sum(1)
    for f in range(v.shape[1]):
        s = row_sums(v[word, f]) / per + v[bins, f].sum(1)
        half += s * s
    half -= row_sums(squares[word]) / per**2 + squares[bins].sum(1)
    return linear + 0.5 * half


def train(rows: list[tuple], epochs: int = 12, batch: int = 64, rate: float = 0.02, seed: int = 7):
    """rows: (distinct word features, their counts, statistic bins, label).  Adam on logistic loss."""
    rng = np.random.default_rng(seed)
    y = np.array([r[3] for r in rows], dtype=np.float64)
    w, v = np.zeros(N_FEATURES), rng.normal(0, 0.02, (N_FEATURES, RANK))
    share = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if len(y) else 0.5
    w0 = float(np.log(share / (1 - share)))
    if len(y) == 0 or y.min() == y.max():
        return w0 if len(y) == 0 else (8.0 if y[0] else -8.0), w, np.zeros((N_FEATURES, RANK))
    cols = [np.concatenate([r[0], r[2]]) for r in rows]
    vals = [np.concatenate([r[1] / max(1, r[1].sum()), np.ones(len(r[2]))]) for r in rows]
    # Word features are many and rare, so they are held back more than statistics.
    l2 = np.where(np.arange(N_FEATURES) < N_WORDS, 3e-3, 1e-4)
    m1w, m2w, m1v, m2v = np.zeros_like(w), np.zeros_like(w), np.zeros_like(v), np.zeros_like(v)
    t = 0
    for epoch in range(epochs):
        order = rng.permutation(len(rows))
        lr = rate * (1 - epoch / epochs) + 1e-4
        for a in range(0, len(order), batch):
            part = order[a : a + batch]
            c = np.concatenate([cols[i] for i in part])
            x = np.concatenate([vals[i] for i in part])
            r = np.repeat(np.arange(len(part)), [len(cols[i]) for i in part])
            vx = v[c] * x[:, None]
            s = np.zeros((len(part), RANK))
            for f in range(RANK):
                s[:, f] = np.bincount(r, weights=vx[:, f], minlength=len(part))
            z = w0 + np.bincount(r, weights=w[c] * x, minlength=len(part)) + 0.5 * ((s**2).sum(1) - np.bincount(r, weights=(vx**2).sum(1), minlength=len(part)))
            g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[part]) / len(part)
            t += 1
            w0 -= lr * g.sum()
            uniq, inv = np.unique(c, return_inverse=True)
            gx = g[r] * x
            gw = np.bincount(inv, weights=gx) + l2[uniq] * w[uniq]
            gv = np.empty((len(uniq), RANK))
            diff = s[r] - vx
            for f in range(RANK):
                gv[:, f] = np.bincount(inv, weights=gx * diff[:, f])
            gv += l2[uniq, None] * v[uniq]
            for p, m1, m2, gr in ((w, m1w, m2w, gw), (v, m1v, m2v, gv)):
                m1[uniq] = 0.9 * m1[uniq] + 0.1 * gr
                m2[uniq] = 0.99 * m2[uniq] + 0.01 * gr * gr
                p[uniq] -= lr * (m1[uniq] / (1 - 0.9 ** min(t, 200))) / (np.sqrt(m2[uniq] / (1 - 0.99 ** min(t, 2000))) + 1e-6)
    return w0, w, v


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = 4000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality"):
    """The model, from at most sample_rows labelled rows outside the held-out third."""
    learn = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & (F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 != 1))
    learn = learn.groupBy(F.col(id_col).cast("long").alias("s_id")).agg(F.max(label_col).cast("int").alias("s_label"))
    chosen = cut(learn.orderBy(F.xxhash64("s_id"), "s_id").limit(sample_rows))
    # The chosen ids are sample_rows at most, so their side has a proven bound.
    rows = docs.select(F.col(id_col).cast("long").alias("s_id"), F.col(text_col).alias("s_text")).join(F.broadcast(chosen), "s_id")

    def run(batches):
        for b in batches:
            label = b.column(0).to_pylist()
            for lo, hi, data, offs in blocks(b.column(1)):
                word, at, bins = features(data, offs)
                out = []
                for i in range(hi - lo):
                    u, c = np.unique(word[at[i] : at[i + 1]], return_counts=True)
                    out.append((u.astype("<i4").tobytes(), c.astype("<i4").tobytes(), bins[i].astype("<i4").tobytes(), label[lo + i]))
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.binary(), pa.binary(), pa.binary(), pa.int32()), strict=True)], names=["u", "c", "b", "y"])

    got = rows.select("s_label", "s_text").mapInArrow(run, "u binary, c binary, b binary, y int").collect()
    read = lambda x: np.frombuffer(x, "<i4")
    got = sorted((bytes(r["b"]), bytes(r["u"]), bytes(r["c"]), r["y"]) for r in got)
    return train([(read(u).astype(np.int64), read(c).astype(np.float64), read(b).astype(np.int64), y) for b, u, c, y in got])


def score(docs: DataFrame, model, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """doc_id, held_out, score and predicted for every row, and the columns in keep."""
    w0, w, v = model
    keep = keep or []
    shared = docs.sparkSession.sparkContext.broadcast((w0, w.astype(np.float32), v.astype(np.float32)))  # fixed size
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("_text"), *keep)
    names = ["doc_id", "held_out", "score", "predicted", *keep]

    def run(batches):
        m0, mw, mv = shared.value
        m = (m0, mw.astype(np.float64), mv.astype(np.float64))
        for b in batches:
            for lo, hi, data, offs in blocks(b.column(1)):
                s = 1 / (1 + np.exp(-np.clip(margins(m, *features(data, offs)), -30, 30)))
                part = b.slice(lo, hi - lo)
                held = [k is not None and zlib.crc32(str(k).encode()) % 3 == 1 for k in part.column(0).to_pylist()]
                cols = [part.column(0), pa.array(held, pa.bool_()), pa.array(s), pa.array((s >= 0.5).astype(np.int32)), *[part.column(i) for i in range(2, part.num_columns)]]
                yield pa.RecordBatch.from_arrays(cols, names=names)

    schema = "doc_id long, held_out boolean, score double, predicted int"
    kept = "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[2:])
    return rows.mapInArrow(run, schema + kept)


def query(spark, sf_dir: str) -> DataFrame:
    from .textblocks import read_table

    docs = read_table(spark, sf_dir, "documents")
    return score(docs, fit(docs, read_table(spark, sf_dir, "labels")))
