"""Spreading activation over facts that share discriminative stems."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import analysis
from ..functions import lexicon as lex
from ..functions import text as T
from ..plans.lineage import cut
from .recall import indexed, with_cues

#: Rows that a task holds before it keeps the best of each query, and cells of a matrix of queries by facts.
KEPT, CELLS = 200_000, 1 << 20
EPSILON, STRENGTH_CAP, STRENGTH_FLOOR = 1e-6, 8.0, 0.05


def spread(queries: DataFrame, episodes: DataFrame, k: int = 16, hops: int = 0) -> DataFrame:
    """(qid, scope, rank, idx, fact, value, seed, act): facts lit by the cue and by what they share.

    hops = 0 runs until nothing new is lit.  Signals are summed per stem before they fan out, so a
    stem with many facts costs its facts once, not its pairs; a fact's own signal is taken back out.
    """
    index = indexed(episodes)
    episodes = index.episodes
    q = cut(with_cues(queries, expand=False))
    keys = ["qid", "scope"]
    cues = q.select(*keys, F.explode("cue").alias("stem"))
    # A seed's activation counts its cue stems among those that may gather.
    counts = index.counts.join(index.sizes, "scope")
    gate = counts.withColumn("rare", F.col("df") <= F.greatest(F.floor(F.col("n") * 0.25), F.lit(64)))
    used = cues.join(gate.select("scope", "stem", "rare"), ["scope", "stem"]).withColumn("any", F.max("rare").over(Window.partitionBy(*keys))).where("rare OR NOT any")
    seeds = used.join(index.postings, ["scope", "stem"]).groupBy(*keys, "idx").agg(F.count(F.lit(1)).cast("double").alias("act"))
    link = counts.where((F.col("df") >= 2) & (F.col("df") <= F.greatest(F.floor(F.col("n") * 0.25), F.lit(4))) & ~F.col("stem").isin(lex.STOP_VALUE_STEMS))
    links = index.postings.join(link.select("scope", "stem", "df"), ["scope", "stem"])
    act, frontier, step = seeds.withColumn("seed", F.lit(True)), seeds, 0
    while hops == 0 or step < hops:
        step += 1
        sent = frontier.join(links, ["scope", "idx"]).withColumn("sig", F.col("act") * 0.5 / F.col("df")).where(F.col("sig") >= EPSILON)
        own = sent.select(*keys, "stem", "idx", "sig")
        pooled = own.groupBy(*keys, "stem").agg(F.sum("sig").alias("total"), F.count(F.lit(1)).alias("senders"))
        got = pooled.join(links, ["scope", "stem"]).join(own.withColumnRenamed("sig", "mine"), [*keys, "stem", "idx"], "left")
        got = got.withColumn("others", F.col("senders") - F.col("mine").isNotNull().cast("int")).where("others > 0")
        add = got.groupBy(*keys, "idx").agg(F.sum(F.col("total") - F.coalesce("mine", F.lit(0.0))).alias("add"))
        both = act.join(add, [*keys, "idx"], "full").select(*keys, "idx", (F.coalesce("act", F.lit(0.0)) + F.coalesce("add", F.lit(0.0))).alias("act"), F.coalesce("seed", F.lit(False)).alias("seed"), F.col("act").isNull().alias("fresh"))
        if hops == 0 or step > 1:
            both = cut(both)
        frontier = both.where("fresh").select(*keys, "idx", "act")
        act = both.drop("fresh")
        if hops == 0 and frontier.isEmpty():
            break
    strength = F.col("strength") if "strength" in episodes.columns else F.lit(1.0)
    out = act.join(episodes.select("scope", "idx", "t", "v", strength.alias("st")), ["scope", "idx"])
    out = out.withColumn("act", F.col("act") * F.least(F.greatest(F.col("st"), F.lit(STRENGTH_FLOOR)), F.lit(STRENGTH_CAP)))
    order = Window.partitionBy(*keys).orderBy(F.desc(F.round("act", 9)), "idx")
    out = out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return out.select(*keys, "rank", "idx", F.col("t").alias("fact"), F.col("v").alias("value"), "seed", "act")


def spread_across(queries: DataFrame, episodes: DataFrame, k: int = 16, hops: int = 0) -> DataFrame:
    """Spread in a base scope and each of its documents, merged: seeds first, then by activation.

    Every query meets every scope of its family, so a task holds one scope's links as a matrix, works out
    all queries that share a stem with it at once and keeps k facts for each query over its scopes.
    """
    index = indexed(episodes)
    base = F.regexp_extract("scope", r"^(.*?)(?:__.*)?$", 1)
    q = cut(with_cues(queries, expand=False).select("qid", F.col("scope").alias("base"), "cue"))
    parts = int(q.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    strength = F.col("strength").cast("double") if "strength" in index.episodes.columns else F.lit(1.0)
    facts = index.episodes.withColumn("base", base).join(q.select("base").distinct(), "base", "left_semi")
    facts = facts.select(F.pmod(F.xxhash64("scope"), F.lit(parts)).cast("int").alias("g"), F.lit(1).alias("role"), "base", "scope", F.col("idx").cast("long").alias("idx"), F.col("s").alias("stems"), F.least(F.greatest(strength, F.lit(STRENGTH_FLOOR)), F.lit(STRENGTH_CAP)).alias("st"))
    asked = q.select(F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("g"), F.lit(0).alias("role"), "base", F.lit("").alias("scope"), F.col("qid").cast("long").alias("idx"), F.col("cue").alias("stems"), F.lit(0.0).alias("st"))
    dealt = asked.unionByName(facts).repartitionById(parts, "g").sortWithinPartitions("g", "role", "base", "scope", "idx")
    blocked = frozenset(lex.STOP_VALUE_STEMS)

    def run(batches):
        by: dict[str, tuple[list, dict]] = {}  # of a base: its queries, and those that hold a stem
        best: dict[str, list] = {}
        group, at, rows = None, None, []
        analysis._tokens.clear()  # what a worker holds from encoding
        analysis._roots.clear()

        def settle():
            if rows:
                ids, holders = by[at[0]]
                held = best.setdefault(at[0], Best(len(ids), k))
                found = None
                if hops == 1:
                    if held.holders is None:
                        held.holders = {x: np.array(qs) for x, qs in holders.items()}
                    found = lit_once(held.place(at[1]), rows, held.holders, held.least, k, blocked)
                if found is None:
                    found = lit(held.place(at[1]), rows, len(ids), holders, k, hops, blocked)
                if found is not None:
                    held.add(found)

        def flush():
            for name, held in best.items():
                held.merge()
                who, sd, act, scope, idx = held.parts[0] if held.parts else NONE
                yield pa.RecordBatch.from_arrays([pa.array([by[name][0][i] for i in who], pa.int64()), pa.array([held.names[i] for i in scope], pa.string()), pa.array(idx), pa.array(sd), pa.array(act)], names=["qid", "scope", "idx", "seed", "act"])

        for b in batches:
            for g, role, name, scope, idx, stems, st in zip(*(b.column(i).to_pylist() for i in range(7)), strict=True):
                if g != group:
                    settle()
                    yield from flush()
                    group, at, rows, by, best = g, None, [], {}, {}
                if role == 0:
                    ids, holders = by.setdefault(name, ([], {}))
                    for x in stems:
                        holders.setdefault(x, []).append(len(ids))
                    ids.append(idx)
                    continue
                if (name, scope) != at:
                    settle()
                    at, rows = (name, scope), []
                rows.append((idx, stems, st))
        settle()
        yield from flush()

    hits = dealt.mapInArrow(run, "qid long, scope string, idx long, seed boolean, act double")
    order = Window.partitionBy("qid").orderBy(F.desc("seed"), F.desc(F.round("act", 9)), "scope", "idx")
    hits = hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    out = hits.join(index.episodes.select("scope", F.col("idx").cast("long").alias("idx"), F.col("t").alias("fact"), F.col("v").alias("value")), ["scope", "idx"])
    return out.select("qid", "scope", "rank", F.col("idx").cast(index.episodes.schema["idx"].dataType).alias("idx"), "fact", "value", "seed", "act")


NONE = (np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64))


class Best:
    """The k best facts of each query of a base over its scopes so far."""

    def __init__(self, n_queries: int, k: int):
        self.k, self.names, self.parts, self.fresh, self.holders = k, [], [], 0, None
        self.least = np.full(n_queries, -np.inf)  # activation of a query's k-th fact where all its facts are seeds

    def place(self, scope: str) -> int:
        """A scope's number; scopes come in their order."""
        self.names.append(scope)
        return len(self.names) - 1

    def add(self, found) -> None:
        self.parts.append(found)
        self.fresh += len(found[0])
        if self.fresh > KEPT // 8:
            self.merge()

    def merge(self) -> None:
        if self.parts:
            who, sd, act, _, _ = self.parts[0] = merged(self.parts, self.k)
            del self.parts[1:]
            self.fresh = 0
            n, at = np.zeros(len(self.least), np.int64), np.flatnonzero(np.diff(np.r_[who, -1]))
            np.add.at(n, who[sd], 1)
            last = at[n[who[at]] == self.k]
            self.least[who[last]] = act[last]


def lit_once(place: int, rows: list, holders: dict, least: np.ndarray, k: int, blocked: frozenset):
    """lit for one hop, only for queries that some fact of the scope may light as much as their least; None where
    the scope is too large for it.

    What one hop adds is linear in what the cue stems light, so a matrix of facts by stems holds it for all queries,
    and the sum of its largest entries over a query's stems is a bound.
    """
    n, at = len(rows), {}
    for i, (_, stems, _) in enumerate(rows):
        for x in stems:
            at.setdefault(x, []).append(i)
    met = [x for x in at if x in holders]
    if not met:
        return NONE
    links = [x for x, f in at.items() if 2 <= len(f) <= max(n // 4, 4) and x not in blocked]
    if n * (len(met) + len(links)) > 4 * CELLS or 0.5 / n < EPSILON:
        return None
    own, link = np.zeros((n, len(met))), np.zeros((n, len(links)))
    for c, x in enumerate(met):
        own[at[x], c] = 1.0
    for c, x in enumerate(links):
        link[at[x], c] = 1.0
    share = np.array([0.5 / len(at[x]) for x in links])
    gain = own + link @ (share[:, None] * (link.T @ own)) - (link @ share)[:, None] * own
    gain[np.abs(gain) < 1e-12] = 0.0  # what a lone sender takes back out
    strength = np.array([r[2] for r in rows])
    most = (gain * strength[:, None]).max(0)
    bound = np.zeros(len(least))
    for x, m in zip(met, most, strict=True):
        bound[holders[x]] += m
    asking = np.flatnonzero((bound > 0) & (bound >= least - 1e-8))
    if not len(asking):
        return NONE
    row_of = np.full(len(least), -1)
    row_of[asking] = np.arange(len(asking))
    asked = [r[r >= 0] for r in (row_of[holders[x]] for x in met)]
    rare = np.array([len(at[x]) <= max(n // 4, 64) for x in met])
    idx, out, block = np.array([r[0] for r in rows], np.int64), [NONE], max(1, CELLS // 4 // max(n, len(met)))
    for lo in range(0, len(asking), block):
        some = np.zeros((min(block, len(asking) - lo), len(met)))
        for c, r in enumerate(asked):
            some[r[np.searchsorted(r, lo) : np.searchsorted(r, lo + block)] - lo, c] = 1.0
        if not rare.all():
            some[np.ix_((some[:, rare] > 0).any(1), ~rare)] = 0.0
        act, seed = some @ gain.T, some @ own.T > 0
        bar = least[asking[lo : lo + block]][:, None]
        who, col = np.nonzero((act > 0) & (act * strength >= bar - 1e-8) & (seed | (bar == -np.inf)))
        out.append(merged([(asking[lo + who], seed[who, col], act[who, col] * strength[col], np.full(len(who), place), idx[col])], k))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def merged(held: list, k: int):
    """The k best facts of each query among (query, seed, act, scope, idx) arrays."""
    who, sd, act, scope, idx = (np.concatenate(x) for x in zip(*held, strict=True))
    order = np.lexsort((idx, scope, -np.round(act, 9), ~sd, who))
    w = who[order]
    first = np.r_[0, np.flatnonzero(np.diff(w)) + 1] if len(w) else np.zeros(0, np.int64)
    place = np.arange(len(w)) - np.repeat(first, np.diff(np.r_[first, len(w)]))
    order = order[place < k]
    return who[order], sd[order], act[order], scope[order], idx[order]


def lit(scope: int, rows: list, n_queries: int, holders: dict, k: int, hops: int, blocked: frozenset):
    """(query, seed, act, scope, idx) of the k best facts that each query lights in one scope; None without any.

    scope: its number; rows: (idx, stems, strength) of its facts.  The rules are those of spread.
    """
    n, at = len(rows), {}
    for i, (_, stems, _) in enumerate(rows):
        for x in stems:
            at.setdefault(x, []).append(i)
    met = [(holders[x], f) for x, f in at.items() if x in holders]
    if not met:
        return None
    rare = [len(f) <= max(n // 4, 64) for _, f in met]
    any_rare = np.zeros(n_queries, bool)
    for (qs, _), r in zip(met, rare, strict=True):
        if r:
            any_rare[qs] = True
    asking = np.unique(np.concatenate([qs for qs, _ in met]))
    row_of = np.full(n_queries, -1)
    row_of[asking] = np.arange(len(asking))
    links = [np.array(f) for x, f in at.items() if 2 <= len(f) <= max(n // 4, 4) and x not in blocked]
    strength = np.array([r[2] for r in rows])
    idx = np.array([r[0] for r in rows], np.int64)
    out = []
    block = max(1, CELLS // n)
    for lo in range(0, len(asking), block):
        m = min(block, len(asking) - lo)
        act = np.zeros((m, n))
        for (qs, f), r in zip(met, rare, strict=True):
            qs = np.array(qs)
            own = row_of[qs if r else qs[~any_rare[qs]]] - lo
            own = own[(own >= 0) & (own < m)]
            act[own[:, None], f] += 1.0
        seed, reached = act > 0, act > 0
        front, step = act.copy(), 0
        while hops == 0 or step < hops:
            step += 1
            add, touched = np.zeros((m, n)), np.zeros((m, n), bool)
            for f in links:
                sig = front[:, f] * 0.5 / len(f)
                sends = (sig >= EPSILON) & (front[:, f] > 0)
                sig = np.where(sends, sig, 0.0)
                others = sends.sum(1)[:, None] - sends > 0
                add[:, f] += np.where(others, sig.sum(1)[:, None] - sig, 0.0)
                touched[:, f] |= others
            fresh = touched & ~reached
            act = act + add
            reached = reached | touched
            front = np.where(fresh, act, 0.0)
            if not fresh.any():
                break
        act = act * strength
        who, col = np.nonzero(reached)
        part = (asking[lo + who], seed[who, col], act[who, col], np.full(len(who), scope), idx[col])
        out.append(merged([part], k))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def spread_trusted(queries: DataFrame, episodes: DataFrame, ledger: DataFrame, k: int = 16, hops: int = 0) -> DataFrame:
    """Spread, ranked again by activation times the trust of each fact's class."""
    from .signals import class_of

    pool = max(k, min(4 * k, 64))
    hits = spread(queries, episodes, pool, hops).withColumn("class", class_of(F.col("fact"), F.col("scope")))
    hits = hits.join(ledger.select("class", "weight"), "class", "left").withColumn("act", F.col("act") * F.coalesce("weight", F.lit(1.0)))
    order = Window.partitionBy("qid", "scope").orderBy(F.desc(F.round("act", 9)), "rank")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).drop("class", "weight")


def shared_stems(text_a: str, text_b: str):
    """Stems that two text columns share."""
    return F.array_intersect(T.cue(F.col(text_a), False), T.cue(F.col(text_b), False))
