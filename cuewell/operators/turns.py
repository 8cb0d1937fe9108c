"""Conversation turns: what a message is, and what answers it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .recall import recall

# First words and phrases that decide what a message is.
ASK_WORDS = "what whats where who when how which".split()
YES_NO_WORDS = "am is are do does did can could will would was were have has".split()
COMMANDS = "count explain list show give make stop repeat calculate compute draw sing translate define describe summarize".split()
GREETINGS = "hi hey hello yo sup howdy".split()
SELF_NAME = ["what's your name", "what is your name", "whats your name", "who are you"]
SELF_NATURE = ["real person", "human", "alive", "robot", " ai ", "sentient", "a machine"]
HOW_ARE = ["how's it going", "how is it going", "how are you", "how you doing", "how are things"]


def arithmetic(text: Column) -> Column:
    """'a op b = c' of the first whole-number operation between spaces; null without one."""
    t = F.concat(F.lit(" "), F.lower(text), F.lit(" "))
    for word, sign in (("divided by", "/"), ("plus", "+"), ("minus", "-"), ("times", "*")):
        t = F.replace(t, F.lit(f" {word} "), F.lit(f" {sign} "))
    trim = r"[?.!,;:'\"()\[\]{}]*"
    pattern = rf"(?:^|\s){trim}([+-]?[0-9]{{1,15}}){trim}\s+([-+*/])\s+{trim}([+-]?[0-9]{{1,15}}){trim}(?=\s|$)"
    a, op, b = (F.regexp_extract(t, pattern, i) for i in (1, 2, 3))
    x, y = (F.when(v != "", v.try_cast("long")) for v in (a, b))
    ratio = F.round(x.cast("double") / F.when(y != 0, y).cast("double"), 6)
    shown = F.when(ratio == F.floor(ratio), F.floor(ratio).cast("string")).otherwise(ratio.cast("string"))
    out = F.when(op == "+", F.try_add(x, y).cast("string")).when(op == "-", F.try_subtract(x, y).cast("string")).when(op == "*", F.try_multiply(x, y).cast("string")).when(op == "/", shown)
    return F.when((a != "") & ~F.contains(text, F.lit("=")), F.concat(x.cast("string"), F.lit(" "), op, F.lit(" "), y.cast("string"), F.lit(" = "), out))


def classify(messages: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds kind (self, smalltalk, math, question, statement), yes_no and math to messages."""
    u = F.trim(text_col)
    df = messages.withColumns({"_u": u, "_l": F.lower(u), "_w": T.words(u), "_f": F.lower(F.trim(F.coalesce(F.get(T.tokens(u), F.lit(0)), F.lit("")), F.lit("?,!")))})
    has = lambda *ws: F.arrays_overlap("_w", T._list(list(ws)))
    some = lambda subs: F.greatest(*[F.instr("_l", s) for s in subs], F.lit(0)) > 0
    starts = lambda *pre: F.col("_l").rlike("^(?:" + "|".join(pre) + ")")
    mine = has("my", "i", "im", "mine")
    about = has("your", "you", "yours") & ~mine
    yes_no = F.col("_f").isin(YES_NO_WORDS) | F.contains("_l", F.lit("yes or no"))
    ask = F.contains("_u", F.lit("?")) | F.col("_f").isin(ASK_WORDS) | yes_no
    head = F.regexp_replace("_f", r"(.)\1+$", "$1")
    greet = starts("good morning", "good afternoon", "good evening") | head.isin(GREETINGS) | F.col("_f").isin(GREETINGS)
    small = greet | starts("lol", "lmao", "haha", "hehe", "thanks", "thank you", "thx", "ty ", "ty$", "bye", "goodbye", "later", "gtg", "good night", "goodnight") | (ask & some(HOW_ARE)) | (F.col("_f").isin(COMMANDS) & ~mine)
    df = df.withColumn("math", arithmetic(F.col("_u")))
    kind = F.when(about & (some(SELF_NAME) | some(SELF_NATURE)), "self").when(small, "smalltalk").when(F.col("math").isNotNull(), "math").when(ask, "question").otherwise("statement")
    return df.withColumns({"kind": kind, "yes_no": yes_no}).drop("_u", "_l", "_w", "_f")


def answer(messages: DataFrame, episodes: DataFrame) -> DataFrame:
    """Replies to messages (qid, scope, text): recall for questions, sums, acknowledgements."""
    df = classify(messages)
    asked = df.where("kind = 'question'").select("qid", "scope", F.col("text").alias("query"))
    hit = recall(asked, episodes).select("qid", "scope", "fact", "value", "coverage", "echo")
    df = df.join(hit, ["qid", "scope"], "left")
    long_fact = F.size(T.tokens(F.col("fact"))) > 6
    sure = (T.is_number(F.col("value")) | (T.is_capital(F.col("value")) & ~long_fact)) & ~F.col("echo")
    shown = F.when(F.length("fact") <= 140, F.trim("fact")).otherwise(F.concat(F.left("fact", F.lit(137)), F.lit("…")))
    known = F.col("fact").isNotNull()
    reply = (
        F.when(F.col("kind") == "math", F.col("math"))
        .when((F.col("kind") == "question") & F.col("yes_no") & known & (F.col("coverage") >= 0.99), "yes")
        .when((F.col("kind") == "question") & F.col("yes_no") & known, F.concat(F.lit("remembered: "), "fact"))
        .when((F.col("kind") == "question") & known & ~sure & (F.col("echo") | long_fact), F.concat(F.lit("remembered: "), shown))
        .when((F.col("kind") == "question") & known, F.col("value"))
        .when(F.col("kind") == "question", "unknown")
        .when(F.col("kind") == "statement", "noted")
        .otherwise("")
    )
    state = F.when(F.col("kind") == "question", F.when(known, "recall").otherwise("idk")).when(F.col("kind") == "statement", "ack").otherwise(F.col("kind"))
    return df.select("qid", "scope", state.alias("kind"), reply.alias("reply"))


def capacity(written: DataFrame, facts: DataFrame, max_facts: int) -> DataFrame:
    """Turns (qid, scope, wrote) with facts, the scope's number after them, and capacity_reached: whether the
    scope was full and something was written, which then is cut off again."""
    n = facts.groupBy("scope").agg(F.count(F.lit(1)).alias("held"))
    both = written.join(n, "scope", "left").withColumn("held", F.coalesce("held", F.lit(0)))
    full = F.col("held") >= max_facts
    after = F.least(F.col("held") + F.col("wrote"), F.lit(max_facts)).cast("long")
    return both.select("qid", "scope", "wrote", after.alias("facts"), (full & (F.col("wrote") > 0)).alias("capacity_reached"))


def route(assessed: DataFrame) -> DataFrame:
    """A rule router over assessments: ANSWER what is covered, FETCH what is half known, else ESCALATE.

    It stands in for a trained dispatcher, whose weights are not public; its rules are its own.
    """
    r = F.when(F.col("has_value") & (F.col("coverage") >= 0.5), "ANSWER").when(F.col("n_hits") > 0, "FETCH").otherwise("ESCALATE")
    return assessed.withColumn("route", r)
