"""Facts as tables: scans, writes and deletes expressed as table-to-table operators.

A facts table has scope, idx (dense insertion order within the scope), t, strength, key.
"""

from __future__ import annotations

import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T

FACT = ["scope", "idx", "t", "strength", "key"]
STRENGTH_CAP, DEDUP_WINDOW, MAX_SENTENCES = 8.0, 4096, 400


def family(scope: Column) -> Column:
    """The part of a scope name before the first :: or __: what one shard or partition holds."""
    return F.regexp_extract(scope, r"^(.*?)(?:(?:::|__).*)?$", 1)


def observe_encoded(messages: DataFrame) -> DataFrame:
    """Messages (scope, seq, text) to encoded facts: sentences without questions, in order."""
    from .encode import encode

    parts = messages.select("scope", "seq", F.posexplode(T.sentences(F.col("text"), MAX_SENTENCES)).alias("place", "t"))
    kept = encode(parts.where(~F.contains("t", F.lit("?"))))
    w = Window.partitionBy("scope").orderBy("seq", "place")
    plain = {"idx": F.row_number().over(w) - 1, "strength": F.lit(1.0), "key": F.lit(None).cast("string")}
    return kept.withColumns(plain).drop("seq", "place")


def observe(messages: DataFrame) -> DataFrame:
    """Messages to a facts table."""
    return observe_encoded(messages).select(FACT)


def number(rows: DataFrame, *order: str) -> DataFrame:
    """A facts table from rows (scope, t) in the given order."""
    w = Window.partitionBy("scope").orderBy(*order)
    return rows.select("scope", (F.row_number().over(w) - 1).alias("idx"), "t", F.lit(1.0).alias("strength"), F.lit(None).cast("string").alias("key"))


def renumber(facts: DataFrame) -> DataFrame:
    """Facts with idx dense again after rows have gone."""
    w = Window.partitionBy("scope").orderBy("idx")
    return facts.withColumn("idx", F.row_number().over(w) - 1)


def append(facts: DataFrame, new: DataFrame) -> DataFrame:
    """Facts followed by new facts of the same scopes."""
    last = facts.groupBy("scope").agg((F.max("idx") + 1).alias("base"))
    moved = new.join(last, "scope", "left").withColumn("idx", F.col("idx") + F.coalesce("base", F.lit(0))).select(FACT)
    return facts.select(FACT).unionByName(moved)


def drop_known(new: DataFrame, facts: DataFrame, window: int = DEDUP_WINDOW) -> DataFrame:
    """New rows (scope, t) whose text isn't among the scope's last facts."""
    n = facts.groupBy("scope").agg(F.max("idx").alias("top"))
    recent = facts.join(n, "scope").where(F.col("idx") > F.col("top") - window).select("scope", "t").distinct()
    return new.join(recent, ["scope", "t"], "left_anti")


def drain(facts: DataFrame, max_facts: int) -> tuple[DataFrame, DataFrame]:
    """The last max_facts facts of each scope, and how many each scope lost."""
    n = facts.groupBy("scope").agg(F.count(F.lit(1)).alias("n"))
    kept = renumber(facts).join(n, "scope").where(F.col("idx") >= F.col("n") - max_facts).drop("n")
    return renumber(kept), n.select("scope", F.greatest(F.col("n") - max_facts, F.lit(0)).alias("dropped"))


def page(facts: DataFrame, start: int, limit: int) -> DataFrame:
    """(scope, total, start, facts) of one page of each scope; limit is clamped to 1..500."""
    limit = min(max(limit, 1), 500)
    inside = F.col("idx").between(start, start + limit - 1)
    cells = F.array_sort(F.collect_list(F.when(inside, F.struct("idx", "t"))))
    return facts.groupBy("scope").agg(F.count(F.lit(1)).alias("total"), cells.alias("x")).select("scope", "total", F.lit(start).alias("start"), F.transform("x", lambda y: y["t"]).alias("facts"))


def catalog(facts: DataFrame) -> DataFrame:
    """Scopes with their number of facts and characters."""
    return facts.groupBy("scope").agg(F.count(F.lit(1)).alias("facts"), F.sum(F.length("t")).alias("chars"))


def stats(facts: DataFrame, max_facts: int) -> DataFrame:
    """One row per scope: facts, max_facts, dropped."""
    n = F.count(F.lit(1))
    return facts.groupBy("scope").agg(F.least(n, F.lit(max_facts)).alias("facts"), F.lit(max_facts).alias("max_facts"), F.greatest(n - max_facts, F.lit(0)).alias("dropped"))


def forget(facts: DataFrame, match: Column) -> DataFrame:
    """Facts that don't hold the match, case ignored."""
    return renumber(facts.where(~F.contains(F.lower("t"), F.lower(match))))


def forget_prefix(facts: DataFrame, prefix: Column) -> DataFrame:
    return renumber(facts.where(~F.startswith(F.lower("t"), F.lower(prefix))))


def forget_key(facts: DataFrame, scopes: DataFrame) -> DataFrame:
    """(scope, key) rows to (scope, forgot, remaining)."""
    hit = facts.join(scopes.withColumn("hit", F.lit(1)), ["scope", "key"], "left")
    return hit.groupBy("scope").agg(F.count("hit").alias("forgot"), F.sum(F.col("hit").isNull().cast("long")).alias("remaining"))


def upsert(facts: DataFrame, new: DataFrame) -> DataFrame:
    """Facts after writing (scope, seq, key, text): the last text of a key replaces older ones.

    A text that stores nothing keeps the old fact.
    """
    from .encode import encode

    w = Window.partitionBy("scope", "key").orderBy(F.desc("seq"))
    fresh = encode(new.select("scope", "seq", "key", F.col("text").alias("t"))).withColumn("r", F.row_number().over(w)).where("r = 1")
    kept = facts.join(fresh.select("scope", "key"), ["scope", "key"], "left_anti").select(FACT)
    order = Window.partitionBy("scope").orderBy("seq")
    added = fresh.select("scope", (F.row_number().over(order) - 1).alias("idx"), "t", F.lit(1.0).alias("strength"), "key")
    return renumber(append(renumber(kept), added))


def set_variables(facts: DataFrame, assignments: DataFrame) -> DataFrame:
    """Facts after (scope, seq, name, value): '{name} is {value}', older facts of the name gone."""
    w = Window.partitionBy("scope", F.lower("name")).orderBy(F.desc("seq"))
    last = assignments.withColumn("r", F.row_number().over(w)).where("r = 1").withColumn("low", F.lower("name"))
    head = F.lower(F.substring_index("t", " is ", 1))
    kept = facts.withColumn("low", head).join(last.select("scope", "low"), ["scope", "low"], "left_anti").select(FACT)
    order = Window.partitionBy("scope").orderBy("seq")
    added = last.select("scope", (F.row_number().over(order) - 1).alias("idx"), F.concat("name", F.lit(" is "), "value").alias("t"), F.lit(1.0).alias("strength"), F.lit(None).cast("string").alias("key"))
    return append(renumber(kept), added)


def heads(text: Column) -> Column:
    """Lower-cased beginnings of a text that stand before ' is ': the names that it may be a variable of."""
    parts = F.split(F.lower(text), " is ", -1)
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda n: F.array_join(F.slice(parts, 1, n), " is "))


def get_variables(facts: DataFrame, names: DataFrame) -> DataFrame:
    """(scope, name) rows with the value of their first fact."""
    known = facts.where(F.contains(F.lower("t"), F.lit(" is "))).select("scope", "idx", "t", F.explode(heads(F.col("t"))).alias("low"))
    hits = names.withColumn("low", F.lower("name")).join(known, ["scope", "low"])
    first = hits.groupBy("scope", "name").agg(F.min_by("t", "idx").alias("t"))
    return first.select("scope", "name", F.expr("substring(t, instr(t, ' is ') + 4)").alias("value"))


def variables(facts: DataFrame) -> DataFrame:
    """(scope, place, name, value): every variable of each scope, sorted by name."""
    at = F.instr("t", " is ")
    pair = facts.where(at > 0).select("scope", F.substring_index("t", " is ", 1).alias("name"), F.expr("substring(t, instr(t, ' is ') + 4)").alias("value"), "idx")
    first = pair.groupBy("scope", "name").agg(F.min_by("value", "idx").alias("value"))
    return first.withColumn("place", F.row_number().over(Window.partitionBy("scope").orderBy("name")))


def delete_variables(facts: DataFrame, names: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Facts without the variables (scope, name), and (scope, name, deleted) with 1 where there was one."""
    keyed = facts.withColumn("low", F.lower(F.substring_index("t", " is ", 1))).where(F.contains("t", F.lit(" is ")))
    wanted = names.withColumn("low", F.lower("name"))
    gone = keyed.join(wanted, ["scope", "low"]).select("scope", "idx", "low").distinct()
    hit = gone.select("scope", "low").distinct().withColumn("deleted", F.lit(1))
    told = wanted.join(hit, ["scope", "low"], "left").select("scope", "name", F.coalesce("deleted", F.lit(0)).alias("deleted"))
    return renumber(facts.join(gone, ["scope", "idx"], "left_anti").select(FACT)), told


def strengthen(facts: DataFrame, matches: DataFrame) -> DataFrame:
    """Facts after (scope, match, bump): strength grows by the bumps of the matches they hold, up to the cap.

    A scope's matches are gathered into one list, so every fact is read once whatever the number of matches.
    """
    bump = F.least(F.greatest(F.col("bump"), F.lit(0.05)), F.lit(4.0))
    lists = matches.groupBy("scope").agg(F.collect_list(F.struct(F.lower("match").alias("m"), bump.alias("b"))).alias("ms"))
    low = F.lower("t")
    total = F.aggregate(F.filter("ms", lambda x: F.contains(low, x["m"])), F.lit(0.0), lambda s, x: s + x["b"])
    joined = facts.join(lists, "scope", "left").withColumn("_b", total)
    up = F.when(F.col("_b") > 0, F.least(F.col("strength") + F.col("_b"), F.greatest(F.lit(STRENGTH_CAP), F.col("strength"))))
    return joined.withColumn("strength", F.coalesce(up, F.col("strength"))).select(FACT)


def decay_others(facts: DataFrame, prefix: Column, factor: float, floor: float) -> DataFrame:
    """Strengths of facts without the prefix, decayed toward a floor."""
    low = F.greatest(F.col("strength") * factor, F.lit(floor))
    return facts.withColumn("strength", F.when(F.startswith(F.lower("t"), F.lower(prefix)), F.col("strength")).otherwise(low))


def dump(facts: DataFrame) -> DataFrame:
    """(scope, blob): one line a fact, flag and key, text and strength, tab-separated and escaped."""
    flag = F.when(F.col("key").isNull(), F.lit("0")).otherwise(F.concat(F.lit("0:"), T.escape(F.col("key"))))
    line = F.concat_ws("\t", flag, T.escape(F.col("t")), F.col("strength").cast("string"))
    cells = F.array_sort(F.collect_list(F.struct("idx", line.alias("line"))))
    return facts.groupBy("scope").agg(F.array_join(F.transform(cells, lambda x: x["line"]), "\n").alias("blob"))


def load(blobs: DataFrame) -> DataFrame:
    """The facts of dumped scopes."""
    lines = blobs.select("scope", F.posexplode(F.split("blob", "\n")).alias("idx", "line")).withColumn("p", F.split("line", "\t", -1))
    key = F.when(F.contains(F.get("p", F.lit(0)), F.lit(":")), T.unescape(F.expr("substring(p[0], instr(p[0], ':') + 1)")))
    return lines.select("scope", "idx", T.unescape(F.get("p", F.lit(1))).alias("t"), F.coalesce(F.try_element_at("p", F.lit(3)).cast("double"), F.lit(1.0)).alias("strength"), key.alias("key"))


def interned_bytes(facts: DataFrame) -> DataFrame:
    """(scope, tokens, vocabulary, bytes): size of each scope with every token stored once."""
    tok = facts.select("scope", F.explode(T.tokens(F.col("t"))).alias("w")).groupBy("scope", "w").agg(F.count(F.lit(1)).alias("n"))
    rank = F.row_number().over(Window.partitionBy("scope").orderBy(F.desc("n"), "w"))
    width = F.when(rank <= 128, 1).when(rank <= 16384, 2).otherwise(3)
    sized = tok.withColumn("b", F.octet_length("w") + 1 + F.col("n") * width)
    return sized.groupBy("scope").agg(F.sum("n").alias("tokens"), F.count(F.lit(1)).alias("vocabulary"), F.sum("b").alias("bytes"))


def scan(facts: DataFrame) -> DataFrame:
    """(scope, place, t): every fact of each scope in insertion order."""
    return renumber(facts.select("scope", "idx", "t")).withColumnRenamed("idx", "place")


def has_fact(facts: DataFrame, wanted: DataFrame) -> DataFrame:
    """The wanted rows (scope, t) that the store holds word for word."""
    return wanted.join(facts.select("scope", "t"), ["scope", "t"], "left_semi")


def by_update(log: DataFrame) -> DataFrame:
    """(scope, created, updated, turns, place) of a write log (scope, seq): scopes by their last write, latest first."""
    from ..plans.numbering import numbered

    by = log.groupBy("scope").agg(F.min("seq").alias("created"), F.max("seq").alias("updated"), F.count(F.lit(1)).alias("turns"))
    return numbered(by.withColumn("_down", -F.col("updated")), ["_down", "scope"], "place").drop("_down")


def observe_durable(messages: DataFrame, facts: DataFrame, window: int = DEDUP_WINDOW) -> DataFrame:
    """Facts after messages (scope, seq, text): a message whose whole text one of the scope's last facts says,
    or a fact of an earlier message of the batch, adds nothing; a batch counts as within the window."""
    from .encode import encode

    parts = messages.select("scope", "seq", F.posexplode(T.sentences(F.col("text"), MAX_SENTENCES)).alias("place", "t"))
    made = encode(parts.where(~F.contains("t", F.lit("?"))))
    first = made.groupBy("scope", "t").agg(F.min("seq").alias("first"))
    whole = messages.select("scope", "seq", F.trim("text").alias("t"))
    fresh = whole.join(first, ["scope", "t"], "left").where(F.col("first").isNull() | (F.col("first") >= F.col("seq")))
    kept = made.join(drop_known(fresh, facts, window).select("scope", "seq"), ["scope", "seq"], "left_semi")
    order = Window.partitionBy("scope").orderBy("seq", "place")
    return append(facts, kept.select("scope", (F.row_number().over(order) - 1).alias("idx"), "t", F.lit(1.0).alias("strength"), F.lit(None).cast("string").alias("key")))


def replay(snapshot: DataFrame, log: DataFrame) -> DataFrame:
    """Facts of a snapshot followed by the facts of its log (scope, seq, t, strength, key) in write order."""
    order = Window.partitionBy("scope").orderBy("seq")
    return append(renumber(snapshot.select(FACT)), log.withColumn("idx", F.row_number().over(order) - 1).select(FACT))


def due(snapshot: DataFrame, log: DataFrame, flush_every: int = 256) -> DataFrame:
    """(scope, stored, logged, due): whether a scope's log has grown to its snapshot, flush_every and 256 rows."""
    a = snapshot.groupBy("scope").agg(F.count(F.lit(1)).alias("stored"))
    b = log.groupBy("scope").agg(F.count(F.lit(1)).alias("logged"))
    both = a.join(b, "scope", "full").select("scope", F.coalesce("stored", F.lit(0)).alias("stored"), F.coalesce("logged", F.lit(0)).alias("logged"))
    return both.withColumn("due", F.col("logged") >= F.greatest(F.col("stored"), F.lit(max(flush_every, 256))))


def compact(snapshot: DataFrame, log: DataFrame, flush_every: int = 256) -> tuple[DataFrame, DataFrame]:
    """Snapshot and log after the logs of due scopes have moved into the snapshot."""
    ready = due(snapshot, log, flush_every).where("due").select("scope")
    moved = log.join(ready, "scope", "left_semi")
    return replay(snapshot, moved), log.join(ready, "scope", "left_anti")


# The typed sub-scopes that go with a wiped scope.
TYPED = ["::var", "::instr", "::stance", "::affect", "::persona"]


def wipe(facts: DataFrame, scopes: DataFrame) -> DataFrame:
    """Facts without whole scopes and their typed sub-scopes."""
    every = scopes.select(F.explode(F.array(F.col("scope"), *[F.concat("scope", F.lit(s)) for s in TYPED])).alias("scope"))
    return facts.join(every, "scope", "left_anti")


def replace_scopes(facts: DataFrame, new: DataFrame) -> DataFrame:
    """Facts with the scopes of new facts replaced by them; other scopes stay."""
    return facts.join(new.select("scope").distinct(), "scope", "left_anti").select(FACT).unionByName(new.select(FACT))


def rewrite(facts: DataFrame, changes: DataFrame) -> DataFrame:
    """Facts after (scope, old, new): the first fact that says old goes, new is written at the end with its
    strength; a change that finds nothing, or whose new text holds no fact, does nothing."""
    from .encode import encode

    at = facts.groupBy("scope", F.col("t").alias("old")).agg(F.min_by(F.struct("idx", "strength"), "idx").alias("x"))
    good = encode(changes.select("scope", "old", F.col("new").alias("t"))).select("scope", "old", "t")
    hit = good.join(at, ["scope", "old"])
    kept = renumber(facts.join(hit.select("scope", F.col("x.idx").alias("idx")), ["scope", "idx"], "left_anti").select(FACT))
    order = Window.partitionBy("scope").orderBy("x.idx", "t")
    moved = hit.select("scope", (F.row_number().over(order) - 1).alias("idx"), "t", F.col("x.strength").alias("strength"), F.lit(None).cast("string").alias("key"))
    return append(kept, moved)


def instructions(added: DataFrame) -> DataFrame:
    """(scope, place, text): standing instructions of each scope in order; empty and repeated ones add nothing."""
    first = added.where("text <> ''").groupBy("scope", "text").agg(F.min("seq").alias("seq"))
    return first.select("scope", (F.row_number().over(Window.partitionBy("scope").orderBy("seq")) - 1).alias("place"), "text")


def delete_instructions(held: DataFrame, needles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Instructions without those that hold a needle (scope, needle; case ignored, an empty one deletes nothing),
    and (scope, deleted)."""
    low = F.lower(F.trim("needle"))
    lists = needles.where(low != "").groupBy("scope").agg(F.collect_set(low).alias("ns"))
    marked = held.join(lists, "scope", "left").withColumn("gone", F.coalesce(F.exists("ns", lambda n: F.contains(F.lower("text"), n)), F.lit(False)))
    told = marked.groupBy("scope").agg(F.sum(F.col("gone").cast("long")).alias("deleted"))
    place = F.row_number().over(Window.partitionBy("scope").orderBy("place")) - 1
    return marked.where("NOT gone").select("scope", place.alias("place"), "text"), told


def clear_instructions(held: DataFrame, scopes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Instructions without those of whole scopes, and (scope, deleted)."""
    told = scopes.join(held.groupBy("scope").agg(F.count(F.lit(1)).alias("deleted")), "scope", "left").select("scope", F.coalesce("deleted", F.lit(0)).alias("deleted"))
    return held.join(scopes, "scope", "left_anti"), told


def pack(blobs: DataFrame) -> DataFrame:
    """(scope, packed): dumped scopes compressed without loss."""
    @F.pandas_udf("binary")
    def squeeze(s: pd.Series) -> pd.Series:
        z = zstandard.ZstdCompressor(level=9)
        return s.map(lambda x: z.compress(x.encode()))

    return blobs.select("scope", squeeze("blob").alias("packed"))


def unpack(packed: DataFrame) -> DataFrame:
    """(scope, blob) of packed scopes; one that is cut short gives what stands before the cut."""
    def whole(x: bytes) -> str:
        out, d = [], zstandard.ZstdDecompressor().decompressobj()
        try:
            for i in range(0, len(x), 1 << 16):
                out.append(d.decompress(x[i : i + (1 << 16)]))
        except zstandard.ZstdError:
            pass
        return b"".join(out).decode(errors="ignore")

    @F.pandas_udf("string")
    def widen(s: pd.Series) -> pd.Series:
        return s.map(lambda x: whole(bytes(x)))

    return packed.select("scope", widen("packed").alias("blob"))
