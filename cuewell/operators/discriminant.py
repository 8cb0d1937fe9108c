"""A discriminant axis between two labelled classes of vectors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import cut
from .vectors import dot

FORGET, LEAST, CLAMP = 1 - 1 / 4096, 8, 4.0


def class_moments(rows: DataFrame, vec_col: str = "vec", class_col: str = "class", age_col: str | None = None):
    """{class: (weight, count, sum)} and the pooled second moment; older rows weigh FORGET^age.

    Partitions send one matrix and one vector a class, whatever their rows.
    """

    def run(batches):
        q, per = None, {}
        for b in batches:
            x = np.array(b.column(0).to_pylist(), dtype=np.float64)
            if not len(x):
                continue
            w = FORGET ** b.column(2).to_numpy().astype(np.float64)
            q = (x * w[:, None]).T @ x if q is None else q + (x * w[:, None]).T @ x
            names = np.array(b.column(1).to_pylist(), dtype=object)
            for c in set(names):
                at = names == c
                weight, n, s = per.get(c, (0.0, 0, 0.0))
                per[c] = (weight + w[at].sum(), n + int(at.sum()), s + (x[at] * w[at][:, None]).sum(0))
        if q is not None:
            out = [("", 0.0, 0, q.ravel().tolist()), *[(c, a, n, s.tolist()) for c, (a, n, s) in per.items()]]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.string(), pa.float64(), pa.int64(), pa.list_(pa.float64())), strict=True)], names=["c", "w", "n", "x"])

    age = F.col(age_col) if age_col else F.lit(0)
    part = cut(rows.select(vec_col, F.col(class_col).cast("string").alias("c"), age.cast("double").alias("a")).mapInArrow(run, "c string, w double, n long, x array<double>"))
    heads = {r["c"]: (r["w"], r["n"]) for r in part.groupBy("c").agg(F.sum("w").alias("w"), F.sum("n").alias("n")).collect()}
    sums: dict[str, list] = {}
    for r in part.select("c", F.posexplode("x").alias("i", "v")).groupBy("c", "i").agg(F.sum("v").alias("v")).orderBy("c", "i").collect():
        sums.setdefault(r["c"], []).append(r["v"])
    if "" not in heads:
        return {}, None
    second = np.array(sums.pop(""))
    d = int(round(len(second) ** 0.5))
    return {c: (heads[c][0], heads[c][1], np.array(s)) for c, s in sums.items()}, second.reshape(d, d)


def axis(moments: dict, second, positive: str, negative: str):
    """(w, c) with w' S w = 1 under the shrunk pooled covariance S; None with too few rows of a class."""
    a, b = moments.get(positive), moments.get(negative)
    if a is None or b is None or a[1] < LEAST or b[1] < LEAST:
        return None
    total = sum(m[0] for m in moments.values())
    within = second / total - sum(np.outer(m[2], m[2]) / m[0] for m in moments.values()) / total
    d = len(within)
    lam = float(np.clip(d / (d + total), 0.05, 0.95))
    s = (1 - lam) * within + lam * (np.trace(within) / d) * np.eye(d)
    pos, neg = a[2] / a[0], b[2] / b[0]
    w = np.linalg.solve(s, pos - neg)
    size = float(np.sqrt(w @ s @ w))
    if size == 0:
        return None
    w /= size
    return w, float(w @ (pos + neg) / 2 + np.log(b[0] / a[0]))


def axis_score(vec: Column, w, c: float) -> Column:
    """Projection on the axis, clamped."""
    z = dot(vec, F.array(*[F.lit(float(x)) for x in w])) - c
    return F.least(F.greatest(z, F.lit(-CLAMP)), F.lit(CLAMP))
