"""Linked facts, read budgets and alternatives.

A link row: id, src_scope, src_text, dst_scope, dst_text, classical (copy, swap, invert or plain
text), ebits.  Moves that depend on one another run in request order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..plans.lineage import cut
from ..plans.numbering import numbered

LOSE, WIN, PRUNE = 0.5, 1.1, 0.1


def entangle(links: DataFrame, new: DataFrame) -> DataFrame:
    """Links after new rows without id; ebits is at least one, ids go on from the largest."""
    base = links.agg(F.coalesce(F.max("id"), F.lit(0)).alias("base"))  # one row
    ranked = numbered(new, ["src_scope", "src_text", "dst_scope", "dst_text"], "id").join(F.broadcast(base))
    return links.unionByName(ranked.withColumn("id", (F.col("id") + F.col("base")).cast("long")).withColumn("ebits", F.greatest("ebits", F.lit(1))).select(links.columns))


def missing_ends(links: DataFrame, facts: DataFrame) -> DataFrame:
    """(scope, t): ends of links that the store doesn't hold yet and has to write."""
    ends = links.select(F.col("src_scope").alias("scope"), F.col("src_text").alias("t")).unionByName(links.select(F.col("dst_scope").alias("scope"), F.col("dst_text").alias("t"))).distinct()
    return ends.join(facts.select("scope", "t"), ["scope", "t"], "left_anti")


def disentangle(links: DataFrame, ids: DataFrame) -> DataFrame:
    """Links without those of some ids."""
    return links.join(ids, "id", "left_anti")


def of_scopes(links: DataFrame, scopes: DataFrame) -> DataFrame:
    """(scope, id): the links that end in a scope, either side, each once."""
    ends = links.select(F.explode(F.array_distinct(F.array("src_scope", "dst_scope"))).alias("scope"), "id")
    return ends.join(scopes, "scope", "left_semi")


def find(links: DataFrame, facts: DataFrame) -> DataFrame:
    """(scope, t, id, partner_scope, partner): links that a fact ends, either side."""
    src = facts.join(links, (facts["scope"] == links["src_scope"]) & (facts["t"] == links["src_text"])).select("scope", "t", "id", F.col("dst_scope").alias("partner_scope"), F.col("dst_text").alias("partner"))
    dst = facts.join(links, (facts["scope"] == links["dst_scope"]) & (facts["t"] == links["dst_text"])).select("scope", "t", "id", F.col("src_scope").alias("partner_scope"), F.col("src_text").alias("partner"))
    return src.unionByName(dst).distinct()


def linked_recall(hits: DataFrame, links: DataFrame) -> DataFrame:
    """Hits with their partners; nothing is spent."""
    return hits.select("qid", "scope", F.col("fact").alias("t")).join(find(links, hits.select("scope", F.col("fact").alias("t")).distinct()), ["scope", "t"], "left")


def invert(value: Column) -> Column:
    """A number negated, any other value reversed."""
    v = F.trim(value)
    whole = F.when(v.rlike(r"^[+-]?[0-9]{1,18}$"), (-v.try_cast("long")).cast("string"))
    real = F.when(v.rlike(r"^[+-]?([0-9]+\.[0-9]*|\.[0-9]+|[0-9]+)([eE][+-]?[0-9]+)?$"), -v.try_cast("double"))
    text = F.when((real == F.floor(real)) & (F.abs(real) < 1e15), F.floor(real).cast("string")).otherwise(real.cast("string"))
    return F.coalesce(whole, text, F.reverse(v))


def reconstruct(classical: Column, fact: Column, value: Column) -> Column:
    """struct(fact, value) that a move writes at its destination."""
    inv = invert(value)
    at = F.instr(fact, value)
    swapped = F.when((at > 0) & (value != "") & (inv != value), F.concat(F.left(fact, at - 1), inv, F.substring(fact, at + F.length(value), F.length(fact)))).otherwise(F.concat(F.lit("the inverted value is "), inv))
    out_fact = F.when(classical.isin("copy", "swap"), fact).when(classical == "invert", swapped).otherwise(classical)
    out_value = F.when(classical.isin("copy", "swap"), value).when(classical == "invert", inv).otherwise(classical)
    return F.struct(out_fact.alias("fact"), out_value.alias("value"))


def teleport(requests: DataFrame, links: DataFrame) -> DataFrame:
    """Recalled facts (qid, scope, fact, value, all of one round) through their first live source link.

    Each link serves as many requests of the round as it has ebits, lowest qid first; a link that
    reaches nought is gone.  Gives what stands at the destination and what the link has left.
    """
    from pyspark.sql.window import Window

    live = links.where("ebits > 0")
    first = live.groupBy("src_scope", "src_text").agg(F.min_by(F.struct("id", "dst_scope", "dst_text", "classical", "ebits"), "id").alias("l"))
    met = requests.join(first, (F.col("scope") == F.col("src_scope")) & (F.col("fact") == F.col("src_text")))
    turn = F.row_number().over(Window.partitionBy("l.id").orderBy("qid"))
    served = met.withColumn("turn", turn).where(F.col("turn") <= F.col("l.ebits"))
    made = reconstruct(F.col("l.classical"), F.col("fact"), F.col("value"))
    return served.withColumn("m", made).select("qid", "scope", "fact", F.col("l.id").alias("id"), F.col("l.dst_scope").alias("dst_scope"), F.col("l.dst_text").alias("old_fact"), F.col("m.fact").alias("dst_fact"), F.col("m.value").alias("value"), F.col("l.classical").alias("classical"), (F.col("l.ebits") - F.col("turn")).alias("ebits_left"))


def after_moves(links: DataFrame, moves: DataFrame) -> DataFrame:
    """Links with ebits spent and ends that follow the moved facts; spent links are gone."""
    used = moves.groupBy("id").agg(F.min("ebits_left").alias("left"), F.max_by("dst_fact", "qid").alias("now"), F.first("classical").alias("how"), F.first("fact").alias("was"))
    out = links.join(used, "id", "left").withColumn("ebits", F.coalesce("left", "ebits")).where("ebits > 0")
    swap = F.col("how") == "swap"
    src = F.when(swap, F.col("dst_text")).otherwise(F.col("src_text"))
    dst = F.when(F.col("now").isNotNull(), F.col("now")).otherwise(F.col("dst_text"))
    return out.withColumns({"src_text": src, "dst_text": dst}).select(links.columns)


def cascade(requests: DataFrame, links: DataFrame, hops: int | None = None) -> DataFrame:
    """Moves carried on from each destination while a live link leads out of it.

    Every move spends an ebit, so the links bound the number of hops; hops sets a lower bound of its own.
    """
    out, now, h = None, requests, 0
    while hops is None or h < hops:
        h += 1
        moves = cut(teleport(now, links).withColumn("hop", F.lit(h)))
        if moves.isEmpty():
            break
        out = moves if out is None else out.unionByName(moves)
        links = cut(after_moves(links, moves))
        now = moves.select("qid", F.col("dst_scope").alias("scope"), F.col("dst_fact").alias("fact"), "value")
    return out if out is not None else teleport(requests, links).withColumn("hop", F.lit(0)).limit(0)


def spend_reads(budgets: DataFrame, reads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Reads (scope, t, seq) under budgets (scope, t, reads): which are served, and what is left.

    A fact whose budget reaches nought is gone.
    """
    from pyspark.sql.window import Window

    turn = F.row_number().over(Window.partitionBy("scope", "t").orderBy("seq"))
    tried = reads.withColumn("turn", turn).join(budgets, ["scope", "t"], "left")
    served = tried.withColumn("served", F.col("reads").isNull() | (F.col("turn") <= F.col("reads"))).select("scope", "t", "seq", "served")
    used = reads.groupBy("scope", "t").agg(F.count(F.lit(1)).alias("n"))
    rest = budgets.join(used, ["scope", "t"], "left").withColumn("reads", F.col("reads") - F.coalesce("n", F.lit(0))).where("reads > 0").select("scope", "t", "reads")
    return served, rest


def measure(alternatives: Column, times: Column) -> Column:
    """struct(chosen, rest) after some measurements of array<struct(alt, w)>.

    The heaviest (first on ties) is chosen and grows, the others fade, and the faded ones go.
    """
    zero = F.struct(F.lit(None).cast("string").alias("chosen"), alternatives.alias("rest"))

    def step(acc, _):
        top = F.array_max(F.transform(acc["rest"], lambda x, i: F.struct(x["w"].alias("w"), (-i).alias("i"))))
        at = -top["i"]
        moved = F.transform(acc["rest"], lambda x, i: F.struct(x["alt"].alias("alt"), F.when(i == at, x["w"] * WIN).otherwise(x["w"] * LOSE).alias("w")))
        chosen = F.get(acc["rest"], at)["alt"]
        return F.struct(F.coalesce(chosen, acc["chosen"]).alias("chosen"), F.filter(moved, lambda x: x["w"] >= PRUNE).alias("rest"))

    return F.aggregate(F.sequence(F.lit(1), times), zero, step)


def best_entry(cues: DataFrame, entries: DataFrame) -> DataFrame:
    """(qid, scope, text): the prepared cue text of most shared stems, at least one."""
    a = cues.select("qid", "scope", F.explode(T.cue(F.col("query"), False)).alias("stem"))
    b = entries.select("scope", "text", F.explode(T.cue(F.col("text"), False)).alias("stem"))
    n = a.join(b, ["scope", "stem"]).groupBy("qid", "scope", "text").agg(F.count(F.lit(1)).alias("ov"))
    return n.groupBy("qid", "scope").agg(F.min_by("text", F.struct(-F.col("ov"), F.col("text"))).alias("text"))


def recall_once(asked: DataFrame, budgets: DataFrame, supers: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Recalled facts (qid, scope, t, seq), each read spent: alternatives first, then the read budget.

    Gives (qid, scope, t, seq, answer, served), the budgets left and the alternatives left; an entry with
    one survivor is a fact from then on and leaves the alternatives.  supers: (scope, t, alts).
    """
    turns = asked.groupBy("scope", "t").agg(F.count(F.lit(1)).cast("int").alias("n"))
    measured = supers.join(turns, ["scope", "t"]).withColumn("m", measure(F.col("alts"), F.col("n")))
    served, rest = spend_reads(budgets, asked.select("scope", "t", "seq"))
    out = asked.join(served, ["scope", "t", "seq"]).join(measured.select("scope", "t", F.col("m.chosen").alias("chosen")), ["scope", "t"], "left")
    left = supers.join(measured.select("scope", "t", F.col("m.rest").alias("rest")), ["scope", "t"], "left").withColumn("alts", F.coalesce("rest", "alts"))
    return out.select("qid", "scope", "t", "seq", F.coalesce("chosen", "t").alias("answer"), "served"), rest, left.where(F.size("alts") > 1).select("scope", "t", "alts")


def superpose(entries: DataFrame) -> DataFrame:
    """(scope, t, alts) of rows (scope, t, alt, seq): alternatives in order, each once, at weight one."""
    first = entries.groupBy("scope", "t", "alt").agg(F.min("seq").alias("seq"))
    by = first.groupBy("scope", "t").agg(F.array_sort(F.collect_list(F.struct("seq", "alt"))).alias("x"))
    return by.select("scope", "t", F.transform("x", lambda x: F.struct(x["alt"].alias("alt"), F.lit(1.0).alias("w"))).alias("alts"))


def survivors(supers: DataFrame) -> DataFrame:
    """(scope, t): the one alternative left of an entry, to be stored as a fact."""
    return supers.where(F.size("alts") == 1).select("scope", F.get("alts", F.lit(0))["alt"].alias("t"))


def place(new: DataFrame, loads: DataFrame, capacity: int | None = None) -> DataFrame:
    """(scope, shard): new scopes in name order, each put on the shard of least load then, the first on ties.

    loads: (shard, load), a row a shard.  Beyond the capacity of all shards, further shards are opened in turn.
    """
    held = {r["shard"]: r["load"] for r in loads.collect()}  # a row a shard
    n = new.count()
    level, spare = _water(held, n, capacity)
    order = numbered(new.select("scope"), ["scope"], "n")
    # Places by level: a shard takes one at each level from its load up to the common one.
    slots = loads.where(F.col("load") <= level).select("shard", F.explode(F.sequence("load", F.lit(level))).alias("at"))
    ranked = numbered(slots, ["at", "shard"], "n").select("n", "shard") if level >= 0 else None
    if ranked is None:
        out = order.withColumn("shard", F.lit(None).cast("long"))
    else:
        out = order.join(ranked, "n", "left")
    if spare:
        first = max(held, default=-1) + 1
        room = max(1, capacity or 1)
        out = out.withColumn("shard", F.coalesce("shard", (F.lit(first) + F.floor((F.col("n") - 1 - F.lit(n - spare)) / room)).cast("long")))
    return out.select("scope", "shard")


def _water(held: dict, n: int, capacity: int | None) -> tuple[int, int]:
    """The highest level that n more scopes reach over shards of some loads, and how many find no room."""
    room = sum(max(0, capacity - x) for x in held.values()) if capacity is not None else n
    if not held:
        return -1, n
    fits = min(n, room)
    if fits == 0:
        return -1, n
    lo, hi = min(held.values()), max(held.values()) + n
    top = hi if capacity is None else capacity - 1
    while lo < hi:  # the lowest level with places enough
        mid = (lo + hi) // 2
        if sum(max(0, min(mid, top) - x + 1) for x in held.values()) >= fits:
            hi = mid
        else:
            lo = mid + 1
    return lo, n - fits
