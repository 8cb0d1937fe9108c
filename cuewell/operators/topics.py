"""Topics of facts: a topic model, topic postings, and a gate that widens fallbacks scope-wide."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T

ALPHA, BETA, TOP, CAP = 0.2, 0.01, 3, 4000


def vocabulary(texts: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(word, df) of words in at least two texts and at most max(texts / 4, 64)."""
    words = texts.select(F.col(id_col).alias("id"), F.explode(F.array_distinct(T.semantic_tokens(F.col(text_col)))).alias("word"))
    counts = words.groupBy("word").agg(F.count(F.lit(1)).alias("df"))
    n = texts.agg(F.count(F.lit(1)).alias("docs"))
    return counts.join(F.broadcast(n)).where("df >= 2 AND df <= greatest(docs / 4, 64)").select("word", "df")  # one row


def token_topics(texts: DataFrame, k: int, sweeps: int = 12, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(id, word, topic, n): topics of each text's words by expectation and maximisation.

    A word's share of a topic starts from a hash.  Each sweep splits every token count among topics
    in proportion to (n_dk + alpha) (n_kw + beta) / (n_k + V beta) under the counts of the sweep
    before, all texts at once, and adds up the parts.  So a sweep is joins and sums, and its result
    doesn't depend on order.
    """
    from ..plans.lineage import cut

    vocab = vocabulary(texts, id_col, text_col)
    size = max(1, vocab.count())
    tok = texts.select(F.col(id_col).alias("id"), F.explode(T.semantic_tokens(F.col(text_col))).alias("word")).groupBy("id", "word").agg(F.count(F.lit(1)).alias("n"))
    tok = cut(tok.join(vocab.select("word"), "word", "left_semi"))
    topics = range(k)
    draw = lambda i: F.conv(F.substring(F.md5(F.concat("word", F.lit(f":{i}"))), 1, 6), 16, 10).cast("long") % 1000
    start = F.array(*[1.0 + draw(i) / 500.0 for i in topics])
    kw = tok.select("word").distinct().withColumn("kw", start)
    dk = tok.select("id").distinct().withColumn("dk", F.array(*[F.lit(1.0)] * k))
    parts = [F.sum(F.col("n") * F.get("r", F.lit(i))) for i in topics]
    for _ in range(sweeps):
        nk = kw.agg(F.array(*[F.sum(F.get("kw", F.lit(i))) for i in topics]).alias("nk"))  # one row
        both = tok.join(kw, "word").join(dk, "id").join(F.broadcast(nk))
        raw = F.array(*[(F.get("dk", F.lit(i)) + ALPHA) * (F.get("kw", F.lit(i)) + BETA) / (F.get("nk", F.lit(i)) + size * BETA) for i in topics])
        both = both.withColumn("raw", raw).withColumn("sum", F.aggregate("raw", F.lit(0.0), lambda x, y: x + y))
        now = cut(both.select("id", "word", "n", F.transform("raw", lambda x: x / F.col("sum")).alias("r")))
        kw = now.groupBy("word").agg(F.array(*parts).alias("kw"))
        dk = now.groupBy("id").agg(F.array(*parts).alias("dk"))
    best = F.array_max(F.transform("r", lambda x, i: F.struct(F.round(x, 9).alias("x"), (-i).alias("i"))))
    return now.select("id", "word", (-best["i"]).alias("topic"), "n")


def mixture(assigned: DataFrame, k: int) -> DataFrame:
    """(id, topic, share, rank): each text's TOP topics by (n + alpha) / (length + k alpha)."""
    by = assigned.groupBy("id", "topic").agg(F.sum("n").alias("n"))
    total = F.sum("n").over(Window.partitionBy("id"))
    shares = by.withColumn("share", (F.col("n") + ALPHA) / (total + k * ALPHA))
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("share"), "topic"))
    return shares.withColumn("rank", rank).where(F.col("rank") <= TOP).select("id", "topic", "share", "rank")


def top_words(assigned: DataFrame, n: int = 8) -> DataFrame:
    """(topic, rank, word, phi) with phi = (n_kw + beta) / (n_k + V beta)."""
    kw = assigned.groupBy("topic", "word").agg(F.sum("n").alias("n"))
    nk = kw.groupBy("topic").agg(F.sum("n").alias("n_k"))
    v = kw.agg(F.countDistinct("word").alias("v"))
    phi = kw.join(nk, "topic").join(F.broadcast(v)).withColumn("phi", (F.col("n") + BETA) / (F.col("n_k") + F.col("v") * BETA))  # one row
    rank = F.row_number().over(Window.partitionBy("topic").orderBy(F.desc("phi"), "word"))
    return phi.withColumn("rank", rank).where(F.col("rank") <= n).select("topic", "rank", "word", "phi")


def scope_topics(assigned: DataFrame, facts: DataFrame) -> DataFrame:
    """(scope, topic, share): share of each scope's facts that post under a topic."""
    posts = assigned.select("id", "topic").distinct().join(facts.select(F.col("id"), "scope"), "id")
    n = facts.groupBy("scope").agg(F.count(F.lit(1)).alias("n"))
    return posts.groupBy("scope", "topic").agg(F.count(F.lit(1)).alias("m")).join(n, "scope").select("scope", "topic", (F.col("m") / F.col("n")).alias("share"))


def fold_in(texts: DataFrame, assigned: DataFrame, k: int, sweeps: int = 5, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(id, topic, share, rank): topics of new texts under counts that stay as they are; texts without a known
    word give no row."""
    from ..plans.lineage import cut

    topics = range(k)
    counts = assigned.groupBy("word").agg(*[F.sum(F.when(F.col("topic") == i, F.col("n")).otherwise(0)).alias(f"k{i}") for i in topics])
    kw = counts.select("word", F.array(*[F.col(f"k{i}").cast("double") for i in topics]).alias("kw"))
    size = max(1, kw.count())
    nk = kw.agg(F.array(*[F.sum(F.get("kw", F.lit(i))) for i in topics]).alias("nk"))  # one row
    phi = kw.join(F.broadcast(nk)).select("word", F.zip_with("kw", "nk", lambda x, y: (x + BETA) / (y + size * BETA)).alias("phi"))
    tok = texts.select(F.col(id_col).alias("id"), F.explode(T.semantic_tokens(F.col(text_col))).alias("word")).groupBy("id", "word").agg(F.count(F.lit(1)).alias("n"))
    tok = cut(tok.join(phi, "word"))
    dk = tok.select("id").distinct().withColumn("dk", F.array(*[F.lit(1.0)] * k))
    for _ in range(sweeps):
        raw = F.zip_with("dk", "phi", lambda d, p: (d + ALPHA) * p)
        both = tok.join(dk, "id").withColumn("raw", raw).withColumn("sum", F.aggregate("raw", F.lit(0.0), lambda x, y: x + y))
        parts = [F.sum(F.col("n") * F.get("raw", F.lit(i)) / F.col("sum")) for i in topics]
        dk = cut(both.groupBy("id").agg(F.array(*parts).alias("dk")))
    total = F.aggregate("dk", F.lit(0.0), lambda x, y: x + y)
    each = dk.select("id", F.posexplode(F.transform("dk", lambda x: (x + ALPHA) / (total + k * ALPHA))).alias("topic", "share"))
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc(F.round("share", 9)), "topic"))
    return each.withColumn("rank", rank).where(F.col("rank") <= TOP).select("id", "topic", F.round("share", 6).alias("share"), "rank")


def postings(assigned: DataFrame, facts: DataFrame, k: int) -> DataFrame:
    """(scope, idx, topic): facts under every topic of their mixture; those without one under bucket k."""
    held = mixture(assigned, k).select("id", "topic")
    both = facts.select("id", "scope", "idx").join(held, "id", "left")
    return both.select("scope", "idx", F.coalesce("topic", F.lit(k)).alias("topic"))


def topic_gate(queries: DataFrame, assigned: DataFrame, facts: DataFrame, k: int | None = None) -> DataFrame:
    """(qid, scope, idx): facts, CAP a query, under a topic of the query's mixture or of one of its words, the
    most recent first; those of the bucket without topic only fill what is left.

    Queries without a known word give no row.  k: number of topics, as many as were assigned if not given.
    """
    if k is None:
        k = (assigned.agg(F.max("topic")).first()[0] or 0) + 1
    word_topic = assigned.groupBy("word", "topic").agg(F.sum("n").alias("n")).groupBy("word").agg(F.max_by("topic", F.struct("n", -F.col("topic"))).alias("topic"))
    by_word = queries.select("qid", "scope", F.explode(F.array_distinct(T.semantic_tokens(F.col("query")))).alias("word")).join(word_topic, "word").select("qid", "scope", "topic")
    whole = fold_in(queries.select(F.struct("qid", "scope").alias("id"), F.col("query").alias("text")), assigned, k)
    wanted = by_word.unionByName(whole.select("id.qid", "id.scope", "topic")).distinct()
    bucket = wanted.select("qid", "scope").distinct().withColumn("topic", F.lit(k))
    posts = postings(assigned, facts, k)
    hits = wanted.unionByName(bucket).join(posts, ["scope", "topic"]).groupBy("qid", "scope", "idx").agg(F.min((F.col("topic") == k).cast("int")).alias("loose"))
    w = Window.partitionBy("qid", "scope").orderBy("loose", F.desc("idx"))
    return hits.withColumn("r", F.row_number().over(w)).where(F.col("r") <= CAP).select("qid", "scope", "idx")
