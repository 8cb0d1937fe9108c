"""The adaptive tier: weights that decay by ticks, links between facts recalled together."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.lineage import cut
from .recall import gather, indexed, score, with_cues

LINK_WINDOW, RING = 3, 32


def effective(weight: Column, tick: Column, now: Column, half_life: float | None) -> Column:
    """A weight halved every half_life ticks; none, nought or less, or infinite: no decay."""
    if half_life is None or half_life <= 0 or half_life == float("inf"):
        return weight
    return weight * F.pow(F.lit(0.5), (now - tick) / half_life)


def session_links(calls: DataFrame) -> DataFrame:
    """(scope, call, idx) of facts stored by one call to (scope, a, b, w): every pair of a call, +1.

    A call holds at most one message's sentences.
    """
    a = calls.select("scope", "call", F.col("idx").alias("a"))
    b = calls.select("scope", "call", F.col("idx").alias("b"))
    return a.join(b, ["scope", "call"]).where("a < b").groupBy("scope", "a", "b").agg(F.count(F.lit(1)).cast("double").alias("w"))


def recall_session(queries: DataFrame, episodes: DataFrame, half_life: float | None = None) -> DataFrame:
    """Recalls queries (qid, scope, seq, query) in order, each hit strengthening its fact.

    Candidates and features come from one batch join; the sequential part, whose every step depends
    on the hits before it, reads a scope's candidate rows in order and keeps only the weights of the
    facts that were hit.
    """
    q = with_cues(queries, expand=False)
    pets = F.col("pet_query") & F.col("es_pet")
    df = score(gather(q, indexed(episodes)), q, episodes)
    df = df.where((F.col("ov") >= 1) | pets).where((~F.col("loose_fact") | pets) & (~F.col("loose_cue") | pets))
    kinds = {"scope": "string", "seq": "long", "qid": "long", "idx": "long", "exact": "int", "selfp": "int", "subj": "int", "spec": "int", "fact": "string"}
    rows = df.withColumn("fact", F.col("t")).select(*[F.col(c).cast(k).alias(c) for c, k in kinds.items()])
    half = half_life if half_life and half_life > 0 else None

    def run(batches):
        scope, turn, best, key, tick = None, None, None, None, 0
        held: dict[int, tuple[float, int]] = {}
        for b in batches:
            out = []
            for r in zip(*(b.column(i).to_pylist() for i in range(len(kinds))), strict=True):
                if (r[0], r[1]) != turn:
                    if best is not None:
                        held[best[3]] = (key[1] + 1.0, tick)
                        out.append((best[0], best[2], best[3], best[8], key[1], tick))
                        tick += 1
                    if r[0] != scope:
                        scope, tick = r[0], 0
                        held.clear()
                    turn, best, key = (r[0], r[1]), None, None
                w, at = held.get(r[3], (1.0, 0))
                k = (r[4], w * (0.5 ** ((tick - at) / half) if half else 1.0), r[5], r[6], r[7], r[3])
                if key is None or k > key:
                    best, key = r, k
            yield batch(out)
        if best is not None:
            yield batch([(best[0], best[2], best[3], best[8], key[1], tick)])

    names = ["scope", "qid", "idx", "fact", "weight", "tick"]
    types = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.int64())

    def batch(out):
        cols = list(zip(*out, strict=True)) if out else [[]] * 6
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)

    return rows.repartition("scope").sortWithinPartitions("scope", "seq", "idx").mapInArrow(run, "scope string, qid long, idx long, fact string, weight double, tick long")


def recall_links(hits: DataFrame, window: int = LINK_WINDOW) -> DataFrame:
    """(scope, a, b, w): half a unit for every pair of hits within window of each other.

    A ring keeps the last RING hits, so no window reaches further.
    """
    window = min(window, RING)
    w = Window.partitionBy("scope").orderBy("tick")
    pairs = hits
    for k in range(1, window + 1):
        pairs = pairs.withColumn(f"p{k}", F.lag("idx", k).over(w))
    each = pairs.select("scope", "idx", F.explode(F.array(*[f"p{k}" for k in range(1, window + 1)])).alias("o")).where("o IS NOT NULL AND o <> idx")
    return each.groupBy("scope", F.least("idx", "o").alias("a"), F.greatest("idx", "o").alias("b")).agg((F.count(F.lit(1)) * 0.5).alias("w"))


def both_ways(links: DataFrame) -> DataFrame:
    return links.unionByName(links.select("scope", F.col("b").alias("a"), F.col("a").alias("b"), "w"))


def related(hits: DataFrame, links: DataFrame, weights: DataFrame, k: int) -> DataFrame:
    """(qid, scope, rank, idx, w): each hit's k strongest neighbours by link times weight."""
    near = hits.select("qid", "scope", F.col("idx").alias("a")).join(both_ways(links), ["scope", "a"]).join(weights.select("scope", F.col("idx").alias("b"), "eff"), ["scope", "b"], "left")
    order = Window.partitionBy("qid", "scope").orderBy(F.desc(F.round(F.col("w") * F.coalesce("eff", F.lit(1.0)), 9)), "b")
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("qid", "scope", "rank", F.col("b").alias("idx"), "w")


def spread_links(seeds: DataFrame, links: DataFrame, weights: DataFrame, hops: int, k: int, reuptake: float = 0.3, fan: int = 8) -> DataFrame:
    """Activation (qid, scope, idx, act) spread along each fact's fan strongest links, hop by hop."""
    edge = both_ways(links).join(weights.select("scope", F.col("idx").alias("b"), "eff"), ["scope", "b"], "left").withColumn("eff", F.coalesce("eff", F.lit(1.0)))
    top = Window.partitionBy("scope", "a").orderBy(F.desc(F.round(F.col("w") * F.col("eff"), 9)), "b")
    edge = edge.withColumn("r", F.row_number().over(top)).where(F.col("r") <= fan)
    total = F.greatest(F.sum("w").over(Window.partitionBy("scope", "a")), F.lit(1.0))
    edge = edge.withColumn("gain", (1.0 - reuptake) * F.col("w") / total * F.least("eff", F.lit(1.0))).select("scope", F.col("a").alias("idx"), "b", "gain")
    act = frontier = seeds.select("qid", "scope", "idx", "act")
    for _ in range(hops):
        sent = frontier.where("act > 1e-9").join(edge, ["scope", "idx"]).withColumn("sig", F.col("act") * F.col("gain")).where("sig > 1e-9")
        frontier = cut(sent.groupBy("qid", "scope", F.col("b").alias("idx")).agg(F.sum("sig").alias("act")))
        act = act.unionByName(frontier)
    out = act.groupBy("qid", "scope", "idx").agg(F.round(F.sum("act"), 4).alias("act"))
    order = Window.partitionBy("qid", "scope").orderBy(F.desc("act"), "idx")
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def consolidate(episodes: DataFrame, weights: DataFrame, prune_below: float, pinned: DataFrame | None = None) -> DataFrame:
    """(scope, idx, merged, eff): facts of equal stem sets as one, weak ones gone unless about oneself or pinned."""
    df = episodes.select("scope", "idx", "s", "self_flag").join(weights.select("scope", "idx", "eff"), ["scope", "idx"], "left").withColumn("eff", F.coalesce("eff", F.lit(1.0)))
    by = df.groupBy("scope", "s").agg(F.min("idx").alias("idx"), F.count(F.lit(1)).alias("merged"), F.sum("eff").alias("eff"), F.min_by("self_flag", "idx").alias("self_flag"))
    if pinned is not None:
        by = by.join(pinned.select("scope", "idx", F.lit(True).alias("pin")), ["scope", "idx"], "left")
    else:
        by = by.withColumn("pin", F.lit(False))
    return by.where((F.col("eff") >= prune_below) | F.col("self_flag") | F.coalesce("pin", F.lit(False))).select("scope", "idx", "merged", "eff")


def rewire(links: DataFrame, survivors: DataFrame, episodes: DataFrame) -> DataFrame:
    """Links after consolidation: ends move to the fact that stands for them, dead ends go."""
    stands = episodes.select("scope", "idx", "s").withColumn("to", F.min("idx").over(Window.partitionBy("scope", "s"))).join(survivors.select("scope", F.col("idx").alias("to")), ["scope", "to"]).select("scope", "idx", "to")
    a = links.join(stands.select("scope", F.col("idx").alias("a"), F.col("to").alias("x")), ["scope", "a"])
    b = a.join(stands.select("scope", F.col("idx").alias("b"), F.col("to").alias("y")), ["scope", "b"]).where("x <> y")
    return b.groupBy("scope", F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.sum("w").alias("w"))


def reinforce(weights: DataFrame, touched: DataFrame, half_life: float | None = None) -> DataFrame:
    """Weights (scope, idx, w, tick) after (scope, idx, tick, by): decayed to the tick, then raised; a fact that
    has no weight yet starts at one."""
    by = touched.groupBy("scope", "idx").agg(F.sum("by").alias("by"), F.max("tick").alias("at"))
    both = weights.join(by, ["scope", "idx"], "full")
    now = effective(F.coalesce("w", F.lit(1.0)), F.coalesce("tick", "at"), F.coalesce("at", "tick"), half_life)
    return both.select("scope", "idx", F.when(F.col("by").isNull(), F.col("w")).otherwise(now + F.col("by")).alias("w"), F.coalesce("at", "tick").alias("tick"))


def strength(weights: DataFrame, now: DataFrame, half_life: float | None = None) -> DataFrame:
    """(scope, idx, eff, facts): effective weights at each scope's tick (scope, now), and how many facts it holds."""
    both = weights.join(now, "scope")
    n = F.count(F.lit(1)).over(Window.partitionBy("scope"))
    return both.select("scope", "idx", effective(F.col("w"), F.col("tick"), F.col("now"), half_life).alias("eff"), n.alias("facts"))
