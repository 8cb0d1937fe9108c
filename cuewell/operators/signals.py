"""Learned signals: contradiction marks, trust, stances, mood and persona."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import lexicon as lex
from ..functions import text as T
from ..functions.hashing import fact_key

LEARN, STALL, RELAX, LOW, HIGH = 0.25, 0.97, 0.01, 0.05, 8.0
BUMP, DECAY, FLOOR, THRESHOLD = 1.0, 0.9, 0.5, 1.5
CHUNK = 4096
NEUTRAL = {k: 0.5 for k in ("openness", "conscientiousness", "extraversion", "agreeableness", "neuroticism")} | {"reactivity": 1.0}


def contradiction(new: Column, old: Column, coverage: Column, overlap: Column) -> Column:
    """'negation', 'value' or null for a new text and a fact that it recalled."""
    nw, ow = T.norm_words(new), T.norm_words(old)
    neg = lambda ws: F.arrays_overlap(ws, T._list(lex.NEGATORS))

    def split(ws):
        """(head, tail) around the first copula; null where none follows a word."""
        at = F.array_min(F.transform(F.filter(F.transform(T._list(["is", "are", "was", "were"]), lambda c: F.array_position(ws, c)), lambda p: p > 0), lambda p: p.cast("int")))
        tail = F.when(at > 1, F.slice(ws, at + 1, F.size(ws)))
        return F.struct(F.when(at > 1, F.array_join(F.slice(ws, 1, at - 1), " ")).alias("head"), tail.alias("tail"))

    def verdict(x):
        a, b = x["a"], x["b"]
        apart = ~F.exists(a["tail"], lambda w: (F.octet_length(w) >= 3) & F.array_contains(b["tail"], w))
        return (a["head"] == b["head"]) & (F.size(a["tail"]) > 0) & (F.size(b["tail"]) > 0) & apart

    close = (overlap >= 3) | (coverage >= 0.6)
    value = T.bind(F.struct(split(nw).alias("a"), split(ow).alias("b")), verdict)
    both = close & (F.size(nw) > 0) & (F.size(ow) > 0)
    return F.when(both & (neg(nw) != neg(ow)), "negation").when(both & value, "value")


def contested(hits: DataFrame, messages: DataFrame) -> DataFrame:
    """(scope, hash, with, reason) marks of both sides of every contradiction among recalled hits."""
    both = hits.join(messages.select("qid", F.col("query").alias("new")), "qid")
    both = both.withColumn("reason", contradiction(F.col("new"), F.col("fact"), F.col("coverage"), F.col("overlap"))).where(F.col("reason").isNotNull())
    side = lambda mine, other: both.select("scope", fact_key(F.col(mine)).alias("hash"), F.left(other, F.lit(160)).alias("with"), "reason")
    return side("new", "fact").unionByName(side("fact", "new")).distinct()


def marks_as_variables(marks: DataFrame) -> DataFrame:
    """Marks as variables (scope, seq, name, value) of each scope's ::contested sub-scope, one for each text:
    the smallest sibling, on one line."""
    flat = F.trim(F.replace(F.regexp_replace("with", r"[\n\r\t]", " "), F.lit(". "), F.lit("; ")))
    by = marks.select("scope", "hash", flat.alias("w")).groupBy("scope", "hash").agg(F.min("w").alias("value"))
    return by.select(F.concat("scope", F.lit("::contested")).alias("scope"), F.lit(0).alias("seq"), F.col("hash").alias("name"), "value")


def stored_marks(facts: DataFrame) -> DataFrame:
    """(scope, hash, with) of the marks that a store holds."""
    own = facts.where(F.endswith("scope", F.lit("::contested")))
    return own.select(F.expr("left(scope, length(scope) - 11)").alias("scope"), F.substring_index("t", " is ", 1).alias("hash"), F.expr("substring(t, instr(t, ' is ') + 4)").alias("with"))


def class_of(fact: Column, scope: Column) -> Column:
    """A fact's provenance: its leading [tag], 'self' for round-stamped ones, else its scope."""
    inside = F.regexp_extract(fact, r"^\s*\[([^\]]*)\]", 1)
    toks = T.tokens(inside)
    first = F.lower(F.trim(F.coalesce(F.get(toks, F.lit(0)), F.lit("")), F.lit("\"'")))
    stamped = F.coalesce(F.get(toks, F.size(toks) - 1), F.lit("")).rlike("^r[0-9]+$")
    return F.when((F.size(toks) > 0) & stamped, "self").when(first != "", first).otherwise(F.lower(scope))


def _then(f: Column, delta: Column) -> Column:
    """The map w -> clamp(a w + b, lo, hi) followed by one round's outcome; such maps compose."""
    d = F.least(F.abs(delta), F.lit(1.0))
    gain = F.when(delta > 0, 1 + LEARN * d).when(delta < 0, 1 - LEARN * d).otherwise(STALL)
    slope = gain * (1 - RELAX)
    move = lambda x: slope * x + RELAX
    held = lambda x: F.least(F.greatest(move(x), F.lit(LOW)), F.lit(HIGH))
    return F.struct((slope * f["a"]).alias("a"), move(f["b"]).alias("b"), held(f["lo"]).alias("lo"), held(f["hi"]).alias("hi"))


def trust(rounds: DataFrame) -> DataFrame:
    """(round, class, delta) to (class, weight, rewards, penalties): a bounded fold in round order.

    A class counts once a round.  Rounds are folded in chunks of CHUNK, each into one clamped linear
    map; a class then folds its maps.  So no list grows with a class's rounds, only with its chunks.
    """
    once = rounds.groupBy("class", "round").agg(F.max("delta").alias("delta")).withColumn("chunk", F.floor(F.col("round") / CHUNK))
    count = lambda c: F.sum(c.cast("long"))
    part = once.groupBy("class", "chunk").agg(F.array_sort(F.collect_list(F.struct("round", "delta"))).alias("ds"), count(F.col("delta") > 0).alias("rewards"), count(F.col("delta") < 0).alias("penalties"))
    same = F.struct(F.lit(1.0).alias("a"), F.lit(0.0).alias("b"), F.lit(float("-inf")).alias("lo"), F.lit(float("inf")).alias("hi"))
    part = part.withColumn("f", F.aggregate("ds", same, lambda f, d: _then(f, d["delta"])))
    whole = part.groupBy("class").agg(F.array_sort(F.collect_list(F.struct("chunk", "f"))).alias("fs"), F.sum("rewards").alias("rewards"), F.sum("penalties").alias("penalties"))
    weight = F.aggregate("fs", F.lit(1.0), lambda w, x: F.least(F.greatest(x["f"]["a"] * w + x["f"]["b"], x["f"]["lo"]), x["f"]["hi"]))
    return whole.select("class", weight.alias("weight"), "rewards", "penalties")


def trust_rank(candidates: DataFrame, ledger: DataFrame) -> DataFrame:
    """(qid, pos, relevance, class) ranked by relevance times trust; earlier position on ties."""
    df = candidates.join(ledger.select("class", "weight"), "class", "left").withColumn("score", F.col("relevance") * F.coalesce("weight", F.lit(1.0)))
    return df.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc(F.round("score", 9)), "pos")))


def modulated(persona: dict[str, float] | None = None) -> dict[str, float]:
    """Stance dynamics under a persona; the neutral persona gives the plain ones."""
    p = NEUTRAL | (persona or {})
    clamp = lambda x, lo, hi: min(max(x, lo), hi)
    brood = (p["conscientiousness"] + p["neuroticism"]) / 2
    return {
        "bump": max(0.0, BUMP * p["reactivity"] * (0.5 + p["neuroticism"])),
        "decay": clamp(DECAY + (brood - 0.5) * 0.2, 0.5, 0.99),
        "threshold": THRESHOLD * (0.7 + 0.6 * p["openness"]),
        "floor": clamp(FLOOR + (p["neuroticism"] - 0.5) * 0.4, 0.0, max(FLOOR, 0.9)),
        "habit": 0.5 + p["conscientiousness"],
    }


def drift(persona: dict[str, float], baseline: dict[str, float], rate: float) -> dict[str, float]:
    """Traits moved toward their baseline by rate."""
    return {k: persona[k] + (baseline[k] - persona[k]) * rate for k in persona}


def stances(notes: DataFrame, persona: dict[str, float] | None = None) -> DataFrame:
    """(scope, seq, topic, feeling) to (scope, topic, feeling, strength).

    Stating a topic adds a bump; every statement of another topic of the scope decays it toward the
    floor.  Between two statements of a topic lie j others, so a statement maps a strength s to
    max(s * decay^j, floor) + bump.  Such maps compose: each chunk of CHUNK statements becomes one, and
    a topic folds its chunks, so no list grows with a topic's statements.
    """
    m = modulated(persona)
    placed = notes.withColumn("low", F.lower(F.trim("topic"))).withColumn("p", F.row_number().over(Window.partitionBy("scope").orderBy("seq")))
    total = notes.groupBy("scope").agg(F.count(F.lit(1)).cast("int").alias("total"))
    own = Window.partitionBy("scope", "low").orderBy("p")
    gaps = placed.withColumns({"j": F.col("p") - F.lag("p").over(own) - 1, "chunk": F.floor((F.row_number().over(own) - 1) / CHUNK)})
    never = F.lit(float("-inf"))
    fade = F.when(F.col("j") > 0, F.pow(F.lit(m["decay"]), F.col("j"))).otherwise(F.when(F.col("j").isNull(), 0.0).otherwise(1.0))
    low = F.when(F.col("j") > 0, F.lit(m["floor"] + m["bump"])).otherwise(never)
    steps = gaps.select("scope", "low", "chunk", "p", F.struct("p", fade.alias("a"), low.alias("lo")).alias("f"), "feeling", "topic")
    # A map is s -> max(a s + b, lo).
    same = F.struct(F.lit(1.0).alias("a"), F.lit(0.0).alias("b"), never.alias("lo"))
    then = lambda f, g: F.struct((g["a"] * f["a"]).alias("a"), (g["a"] * f["b"] + g["b"]).alias("b"), F.greatest(F.when(f["lo"] > never, g["a"] * f["lo"] + g["b"]).otherwise(never), g["lo"]).alias("lo"))
    with_bump = lambda f: F.struct(f["a"].alias("a"), F.lit(m["bump"]).alias("b"), f["lo"].alias("lo"))
    last = F.max(F.struct("p", "feeling", "topic")).alias("last")
    part = steps.groupBy("scope", "low", "chunk").agg(F.array_sort(F.collect_list("f")).alias("fs"), last)
    part = part.withColumn("f", F.aggregate("fs", same, lambda x, g: then(x, with_bump(g))))
    by = part.groupBy("scope", "low").agg(F.array_sort(F.collect_list(F.struct("chunk", "f"))).alias("fs"), F.max("last").alias("last")).join(total, "scope")
    whole = F.aggregate("fs", same, lambda x, g: then(x, g["f"]))
    strength = T.bind(whole, lambda f: F.greatest(f["b"], f["lo"]))  # from nought
    j = F.col("total") - F.col("last.p")
    faded = F.when(j > 0, F.greatest(F.col("s") * F.pow(F.lit(m["decay"]), j), F.lit(m["floor"]))).otherwise(F.col("s"))
    return by.withColumn("s", strength).select("scope", F.col("last.topic").alias("topic"), F.col("last.feeling").alias("feeling"), faded.alias("strength"))


def topic_matches(stored: Column, asked: Column) -> Column:
    """Whole word or whole phrase, never part of a word."""
    s, a = F.lower(stored), F.lower(asked)
    return (s != "") & (a != "") & ((s == a) | F.array_contains(T.tokens(a), s) | F.array_contains(T.tokens(s), a))


def directive(moods: DataFrame, views: DataFrame, persona: dict[str, float] | None = None) -> DataFrame:
    """(scope, mood, asked) with each scope's view that should show: the asked one, else the strongest.

    A view that nobody asked for shows from the persona's threshold on.
    """
    threshold = modulated(persona)["threshold"]
    best = views.join(moods.select("scope", "asked"), "scope", "right").withColumn("hit", F.coalesce(topic_matches(F.col("topic"), F.col("asked")), F.lit(False)))
    w = Window.partitionBy("scope").orderBy(F.desc("hit"), F.desc("strength"), "topic")
    top = best.withColumn("r", F.row_number().over(w)).where("r = 1")
    shown = top.withColumn("show", F.coalesce(F.col("hit") | (F.col("strength") >= threshold), F.lit(False)))
    view = F.when(F.col("show"), F.format_string('%s (x%.0f): "%s"', "topic", "strength", "feeling"))
    out = moods.join(shown.select("scope", view.alias("view")), "scope", "left")
    return out.select("scope", F.trim(F.concat_ws(" ", F.concat(F.lit("mood: "), F.nullif(F.trim("mood"), F.lit(""))), F.concat(F.lit("view: "), "view"))).alias("directive"))


def resolve_capabilities(capabilities: DataFrame, host: list[str]) -> DataFrame:
    """(name, kind) with who serves each: the store what is grounded, the host what it can and may."""
    ceded = (F.col("kind") == "deferrable") & F.col("name").isin(host)
    return capabilities.withColumn("served_by", F.when(ceded, "host").otherwise("store"))


#: Traits from which on, and up to which, a persona is described by a word.
HIGH_TRAIT, LOW_TRAIT = 0.66, 0.34
# Words of high and low traits, for the description and for the voice.
TRAIT_WORDS = {
    "openness": ("curious", "conventional"), "conscientiousness": ("disciplined", "easygoing"), "extraversion": ("outgoing", "reserved"),
    "agreeableness": ("warm", "blunt"), "neuroticism": ("volatile", "even-keeled"),
}
BALANCED = "balanced, even-tempered"


def describe(traits: dict[str, Column]) -> Column:
    """The words of a persona's high and low traits; a balanced one has its own."""
    words = [F.when(traits[name] >= HIGH_TRAIT, high).when(traits[name] <= LOW_TRAIT, low) for name, (high, low) in TRAIT_WORDS.items()]
    return F.coalesce(F.nullif(F.concat_ws(", ", *words), F.lit("")), F.lit(BALANCED))


def persona_rows(personas: DataFrame) -> DataFrame:
    """Personas (scope, a column for each trait, reactivity) as variables (scope, name, value) to store."""
    names = [c for c in personas.columns if c != "scope"]
    pairs = F.array(*[F.struct(F.lit(n).alias("name"), F.format_string("%.4f", F.col(n).cast("double")).alias("value")) for n in names])
    return personas.select("scope", F.inline(pairs))


def load_personas(variables: DataFrame) -> DataFrame:
    """Stored variables (scope, name, value) as personas; traits are clamped, missing ones neutral."""
    cols = [F.max(F.when(F.col("name") == n, F.col("value").try_cast("double"))).alias(n) for n in NEUTRAL]
    by = variables.groupBy("scope").agg(*cols)
    top = lambda n: 2.0 if n == "reactivity" else 1.0
    return by.select("scope", *[F.coalesce(F.least(F.greatest(F.col(n), F.lit(0.0)), F.lit(top(n))), F.lit(v)).alias(n) for n, v in NEUTRAL.items()])


def observe_checked(new: DataFrame, hits: DataFrame) -> DataFrame:
    """(qid, scope, query) to store and the facts they recall, to the marks that the write leaves: whatever
    the verdict, the text is stored; both sides of a contradiction are marked once."""
    return contested(hits, new)


def scored(hits: DataFrame, marks: DataFrame) -> DataFrame:
    """Hits with contested, and with: the sibling that a mark names (the smallest of several), else null."""
    one = marks.groupBy("scope", "hash").agg(F.min("with").alias("with"))
    keyed = hits.withColumn("hash", fact_key(F.col("fact")))
    return keyed.join(one, ["scope", "hash"], "left").withColumn("contested", F.col("with").isNotNull()).drop("hash")


def reinforce(facts: DataFrame, notes: DataFrame, bump: float = BUMP) -> DataFrame:
    """Facts after (scope, topic, feeling): the first fact that starts with the topic gains strength, says the
    new feeling and moves to the end; a topic without one is written at the bump."""
    from .store import FACT, append, renumber

    low = F.lower(F.concat(F.trim("topic"), F.lit(":")))
    head = F.lower(F.concat(F.substring_index("t", ":", 1), F.lit(":")))
    first = facts.withColumn("low", head).groupBy("scope", "low").agg(F.min_by(F.struct("idx", "strength"), "idx").alias("old"))
    told = notes.withColumn("low", low).join(first, ["scope", "low"], "left")
    gone = told.where(F.col("old").isNotNull()).select("scope", F.col("old.idx").alias("idx"))
    kept = renumber(facts.join(gone, ["scope", "idx"], "left_anti").select(FACT))
    text = F.concat(F.trim("topic"), F.lit(": "), F.trim("feeling"))
    order = Window.partitionBy("scope").orderBy("low")
    new = told.select("scope", (F.row_number().over(order) - 1).alias("idx"), text.alias("t"), (F.coalesce("old.strength", F.lit(0.0)) + bump).alias("strength"), F.lit(None).cast("string").alias("key"))
    return append(kept, new)


def why(topics: DataFrame, views: DataFrame, hits: DataFrame) -> DataFrame:
    """(qid, scope, topic) to the view held on it and the facts recalled for it, as evidence in rank order;
    a topic without a view gives no row."""
    met = topics.join(views.withColumnRenamed("topic", "held"), "scope").where(topic_matches(F.col("held"), F.col("topic")))
    view = met.groupBy("qid", "scope", "topic").agg(F.max_by(F.struct("feeling", "strength"), F.struct("strength", "held")).alias("v"))
    found = hits.groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "fact"))), lambda x: x["fact"]).alias("evidence"))
    none = F.array().cast("array<string>")
    return view.join(found, "qid", "left").select("qid", "scope", "topic", "v.feeling", F.col("v.strength").alias("intensity"), F.coalesce("evidence", none).alias("evidence"))
