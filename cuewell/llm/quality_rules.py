"""Operator 7: quality rules with robust multivariate outliers, native DataFrame functions only.

Base counts come from array functions, one pass over the texts, no shuffle.  The verdict: per
language and source, a minimum-covariance-determinant estimate of the centre and covariance of
transformed statistics.  Three starts (distances from the medians under fixed scales and under
quartile scales, and under the moments of all rows) each take two concentration steps: distances,
the closest three quarters, their moments.  Of each group the start of smallest determinant goes on
until its own determinant falls no more, and the estimate of smallest determinant stands.  Covariances
are regularised and shrunk toward the pooled one, so that groups of one row, of equal rows or with
tied distances (all rows at the limit count as close) stay well-defined.  A document whose squared
Mahalanobis distance passes a chi-square quantile fails.

The statistics are written once (checkpoint); each step moves only partial sums and quantile
sketches, so a source with a third of all rows costs no task more than its share.

Null text: no words, so base_failed.  Null language or source: a group of its own (as empty).
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lineage import cut

GAP = r"[\x20\x09-\x0D]+"
WINDOW = 5
DIMS = ["z1", "z2", "z3", "z4"]
START = "g_start"
#: Smallest standard deviation of each transformed statistic that counts as spread.
FLOORS = [0.12, 0.12, 0.25, 0.25]
KEEP_SHARE, SHRINK, TAIL = 0.75, 30.0, 1e-6
#: Steps of every start; steps of the best one at most, and the share by which its determinant must fall to go on.
FIRST_STEPS, MOST_STEPS, FALL = 2, 10, 1e-4
#: Groups whose parameters (some 200 bytes each) may be broadcast, and salts beyond that.
FEW_GROUPS, SALTS = 10_000, 32


def base_counts(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    df = df.withColumn("_t", text).withColumn("_w", F.array_remove(F.split("_t", GAP), ""))
    df = df.withColumns(
        {
            "n_words": F.size("_w").cast("long"),
            "word_chars": F.length(F.array_join("_w", "")).cast("long"),
            "n_symbols": (F.length("_t") - F.length(F.regexp_replace("_t", r"[#*$%&|<>]+", ""))).cast("long"),
            "_l": F.filter(F.split("_t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")),
            "_h": F.transform("_w", lambda w: F.xxhash64(w)),
        }
    )
    df = df.withColumns(
        {
            "n_dup_lines": (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long"),
            "_v": F.when(
                F.size("_h") >= WINDOW,
                F.transform(F.sequence(F.lit(0), F.size("_h") - WINDOW), lambda i: F.xxhash64(*[F.get("_h", i + k) for k in range(WINDOW)])),
            ).otherwise(F.array().cast("array<long>")),
        }
    )
    # Only a text with an equal pair of windows pays for the sort.
    zipped = F.sort_array(F.transform("_v", lambda h, i: F.struct(h.alias("h"), i.alias("p"))))
    df = df.withColumn("_s", F.when(F.size("_v") != F.size(F.array_distinct("_v")), zipped))
    again = F.filter("_s", lambda x, i: ((i > 0) & (F.get("_s", i - 1)["h"] == x["h"])) | ((i < F.size("_s") - 1) & (F.get("_s", i + 1)["h"] == x["h"])))
    df = df.withColumn("_p", F.sort_array(F.transform(again, lambda x: x["p"])))
    cover = F.transform("_p", lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get("_p", i + 1) - p, F.lit(WINDOW))).cast("long"))
    df = df.withColumn("n_repeat_words", F.coalesce(F.aggregate(cover, F.lit(0).cast("long"), lambda a, b: a + b), F.lit(0).cast("long")))
    return df.drop("_t", "_w", "_l", "_h", "_v", "_s", "_p")


def _statistics() -> dict:
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    return {
        "z1": F.log(F.greatest(F.col("word_chars"), F.lit(1)) / n),
        "z2": F.log1p(10 * F.col("n_symbols") / n),
        "z3": F.log1p(10 * F.col("n_repeat_words") / n),
        "z4": F.log1p(F.col("n_dup_lines").cast("double")),
    }


def _chi2_cdf(x: float, df: int) -> float:
    """Chi-square distribution for an even number of degrees of freedom."""
    term, total = 1.0, 0.0
    for k in range(df // 2):
        total += term
        term *= x / 2 / (k + 1)
    return 1 - math.exp(-x / 2) * total


def chi2_quantile(p: float, df: int) -> float:
    lo, hi = 0.0, 1e3
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if _chi2_cdf(mid, df) < p else (lo, mid)
    return hi


def _moments(rows: DataFrame, keys: list[str]) -> DataFrame:
    d = range(len(DIMS))
    sums = [F.count(F.lit(1)).alias("n")] + [F.sum(DIMS[i]).alias(f"s{i}") for i in d]
    sums += [F.sum(F.col(DIMS[i]) * F.col(DIMS[j])).alias(f"q{i}{j}") for i in d for j in range(i + 1)]
    return rows.groupBy(*keys).agg(*sums)


def _parameters(sums: DataFrame, keys: list[str], scale: float) -> DataFrame:
    """Centre and Cholesky factor of each group, shrunk toward the pooled moments."""
    d = range(len(DIMS))
    pooled_n = F.sum("n")
    # Pooled centre and within-group covariance: one row (for each start), joined to every group.
    within = [
        (F.sum(F.col(f"q{i}{j}") - F.col(f"s{i}") * F.col(f"s{j}") / F.col("n")) / pooled_n).alias(f"pc{i}{j}") for i in d for j in range(i + 1)
    ]
    by = [START] if START in keys else []
    pooled = sums.groupBy(*by).agg(*[(F.sum(f"s{i}") / pooled_n).alias(f"pm{i}") for i in d], *within)
    p = sums.join(F.broadcast(pooled), by) if by else sums.join(F.broadcast(pooled))  # three rows at most
    w = F.col("n") / (F.col("n") + SHRINK)
    p = p.withColumns({f"m{i}": w * F.col(f"s{i}") / F.col("n") + (1 - w) * F.col(f"pm{i}") for i in d})
    cov = {}
    for i in d:
        for j in range(i + 1):
            own = F.col(f"q{i}{j}") / F.col("n") - F.col(f"s{i}") * F.col(f"s{j}") / F.col("n") ** 2
            c = scale * (w * own + (1 - w) * F.col(f"pc{i}{j}"))
            cov[f"c{i}{j}"] = c + FLOORS[i] ** 2 if i == j else c
    p = p.withColumns(cov)
    for i in d:
        for j in range(i + 1):
            rest = F.col(f"c{i}{j}")
            for k in range(j):
                rest = rest - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            p = p.withColumn(f"l{i}{j}", F.sqrt(F.greatest(rest, F.lit(1e-9))) if i == j else rest / F.col(f"l{j}{j}"))
    det = F.lit(1.0)
    for i in d:
        det = det * F.col(f"l{i}{i}") ** 2
    return p.select(*keys, "n", det.alias("det"), *[f"m{i}" for i in d], *[f"l{i}{j}" for i in d for j in range(i + 1)])


def _match(rows: DataFrame, groups: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with what a written table says of their group.

    A few groups are broadcast; beyond that their rows are dealt by group and a salt of the id, so a
    group with a third of all rows is spread over SALTS tasks.
    """
    if groups.count() <= FEW_GROUPS:
        return rows.join(F.broadcast(groups), keys)
    salted = groups.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")).join(salted, [*keys, "salt"]).drop("salt")


def _distance(rows: DataFrame, params: DataFrame, keys: list[str]) -> DataFrame:
    """Adds d2, the squared Mahalanobis distance to the row's group."""
    out = _match(rows, params, keys)
    for i, z in enumerate(DIMS):
        y = F.col(z) - F.col(f"m{i}")
        for k in range(i):
            y = y - F.col(f"l{i}{k}") * F.col(f"y{k}")
        out = out.withColumn(f"y{i}", y / F.col(f"l{i}{i}"))
    total = F.lit(0.0)
    for i in range(len(DIMS)):
        total = total + F.col(f"y{i}") ** 2
    return out.withColumn("d2", total).select(*rows.columns, "d2")


def _concentrate(ranked: DataFrame, keys: list[str]) -> DataFrame:
    """One step: the moments of each group's rows of smallest d2."""
    limit = cut(ranked.groupBy(*keys).agg(F.percentile_approx("d2", KEEP_SHARE, 1000).alias("limit")))
    close = _match(ranked, limit, keys).where(F.col("d2") <= F.col("limit"))
    return cut(_moments(close, keys))  # one row for each group


def _estimate(stats: DataFrame, keys: list[str]) -> DataFrame:
    """The estimate of smallest determinant of each group: centre (m), Cholesky factor (l) and det."""
    d = len(DIMS)
    cut_at = chi2_quantile(KEEP_SHARE, d)
    scale = KEEP_SHARE / _chi2_cdf(cut_at, d + 2)
    quartiles = [F.percentile_approx(z, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), 1000).alias(f"q{i}") for i, z in enumerate(DIMS)]
    middle = cut(stats.groupBy(*keys).agg(*quartiles))
    whole = cut(_parameters(_moments(stats, keys), keys, 1.0))
    fixed, own = F.lit(0.0), F.lit(0.0)
    for i, z in enumerate(DIMS):
        gap = F.col(z) - F.get(f"q{i}", F.lit(1))
        fixed = fixed + (gap / FLOORS[i]) ** 2
        own = own + (gap / F.greatest((F.get(f"q{i}", F.lit(2)) - F.get(f"q{i}", F.lit(0))) / 1.349, F.lit(FLOORS[i]))) ** 2
    far = _distance(stats, whole, keys).withColumnRenamed("d2", "whole")
    starts = F.array(*[F.struct(F.lit(i).alias(START), x.alias("d2")) for i, x in enumerate((fixed, own, F.col("whole")))])
    ranked = _match(far, middle, keys).select(*stats.columns, F.inline(starts))
    each = [*keys, START]
    params = None
    for step in range(FIRST_STEPS):
        params = cut(_parameters(_concentrate(ranked, each), each, scale))
        if step + 1 < FIRST_STEPS:
            three = stats.withColumn(START, F.explode(F.array(*[F.lit(i) for i in range(3)])))
            ranked = _distance(three, params, each)
    first = params.groupBy(*keys).agg(F.min_by(F.struct(*[c for c in params.columns if c not in keys]), F.struct("det", START)).alias("x"))
    best = cut(first.select(*keys, *[F.col(f"x.{c}").alias(c) for c in params.columns if c not in each]))
    now, sums = best, None
    for _ in range(MOST_STEPS):
        # Only groups that still fall take a step; the others' last moments stay in the pooled ones.
        fresh = _concentrate(_distance(stats, now, keys), keys)
        sums = fresh if sums is None else cut(fresh.unionByName(sums.join(fresh, keys, "left_anti")))
        new = cut(_parameters(sums, keys, scale).join(fresh.select(*keys), keys, "left_semi"))
        old = best.select(*keys, F.struct(*[c for c in best.columns if c not in keys]).alias("old"))
        both = old.join(new, keys, "left")  # a row for each group, null where it has stopped
        lower, fell = (F.coalesce(F.col("det") < F.col("old.det") * x, F.lit(False)) for x in (1.0, 1 - FALL))
        better = cut(both.select(*keys, *[F.when(lower, F.col(c)).otherwise(F.col(f"old.{c}")).alias(c) for c in new.columns if c not in keys], fell.alias("fell")))
        best = better.drop("fell")
        now = cut(new.join(better.where("fell").select(*keys), keys, "left_semi"))
        if now.isEmpty():
            break
    return best


def judge(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """Base counts, base_failed and kept for every row."""
    keys = ["g_lang", "g_source"]
    rows = df.select(
        F.col(id_col).alias("doc_id"),
        F.col(text_col).alias("text"),
        F.coalesce(F.col(lang_col), F.lit("")).alias("g_lang"),
        F.coalesce(F.col(source_col), F.lit("")).alias("g_source"),
    )
    stats = cut(base_counts(rows).drop("text").withColumns(_statistics()))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    params = _estimate(stats.where(~failed), keys)
    limit = chi2_quantile(1 - TAIL, len(DIMS))
    scored = _distance(stats.where(~failed), params, keys).select("doc_id", *keys, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", F.lit(False).alias("base_failed"), (F.col("d2") <= limit).alias("kept"))
    out = scored.unionByName(stats.where(failed).select("doc_id", *keys, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", F.lit(True).alias("base_failed"), F.lit(False).alias("kept")))
    return out.drop(*keys)


def query(spark, sf_dir: str) -> DataFrame:
    from .textblocks import read_table

    return judge(read_table(spark, sf_dir, "documents"))
