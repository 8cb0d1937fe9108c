"""Registered queries over word vectors, recall by meaning, axes and topics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .catalog import episodes, last_sentences, messages, table, trust_rounds
from .functions import text as T
from .operators import adaptive, discriminant, graph, models, recall, semantic, signals, topics, vectors
from .plans.lineage import cut, written


def trained(spark, sf) -> DataFrame:
    """Word vectors of all conversations, packed."""
    return written(vectors.train_packed(messages(spark, sf)))


def q_totals(spark, sf):
    return vectors.semantic_totals(trained(spark, sf), vectors.word_counts(messages(spark, sf)))


def q_nearest(spark, sf):
    """Five words nearest to the first one of every conversation."""
    words = cut(vectors.dense(trained(spark, sf), ["word"]).withColumnRenamed("word", "id"))
    first = messages(spark, sf).groupBy("scope").agg(F.min_by("text", "seq").alias("text"))
    asked = first.select(F.get(T.semantic_tokens(F.col("text")), F.lit(0)).alias("id")).where("id IS NOT NULL").distinct()
    near = vectors.nearest(words, words.join(asked, "id", "left_semi").withColumnRenamed("id", "qid"), 5)
    return near.select("qid", "rank", "id", F.round("cosine", 6).alias("cosine"))


def last_messages(spark, sf) -> DataFrame:
    last = messages(spark, sf).groupBy("scope").agg(F.max_by("text", "seq").alias("query"))
    return last.select(F.col("scope").cast("long").alias("qid"), "scope", "query")


def q_semantic(spark, sf):
    """Each conversation's last message, by meaning among its facts."""
    every = semantic.cosines(last_messages(spark, sf), episodes(spark, sf).select("scope", "idx", "t"), trained(spark, sf))
    return semantic.standing(every.where("idx IS NOT NULL")).select("qid", "idx", F.round("cosine", 6).alias("cosine"))


def q_blended(spark, sf):
    axis = [(1.0 if i % 2 else -1.0) / 16 for i in range(vectors.DIM)]
    out = semantic.recall_blended_texts(last_messages(spark, sf), episodes(spark, sf).select("scope", "idx", "t"), trained(spark, sf), 5, (axis, 0.01))
    return out.select("qid", "rank", "idx", F.round("score", 9).alias("score"))


def q_durable(spark, sf):
    """Each conversation asked for the last sentence of the one before: by cue, else by meaning."""
    e = episodes(spark, sf)
    asked = last_sentences(e).select((F.col("qid") + 1).alias("qid"), (F.col("qid") + 1).cast("string").alias("scope"), "query")
    asked = asked.join(e.select("scope").distinct(), "scope", "left_semi").select("qid", "scope", "query")
    return semantic.recall_durable_texts(asked, e, trained(spark, sf)).select("qid", "idx", F.round("coverage", 6).alias("coverage"), "overlap", "exact")


def q_axis_rank(spark, sf):
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.transform("embedding", lambda x: x.cast("double")).alias("vec"))
    out = vectors.axis_rank(e, [(-1.0) ** i / 8 for i in range(64)], 0.01)
    return out.select("id", F.round("z", 9).alias("z"), "rank")


def q_classes(spark, sf):
    """Effective weights of label classes when vectors are seen in id order and older ones fade."""
    e = table(spark, sf, "embeddings")
    last = e.agg(F.max("vec_id").alias("top"))
    rows = e.join(F.broadcast(last)).select(F.transform("embedding", lambda x: x.cast("double")).alias("vec"), F.col("label").cast("string").alias("class"), (F.col("top") - F.col("vec_id")).alias("age"))  # one row
    found, second = discriminant.class_moments(rows, age_col="age")
    kept = models.moments_of(cut(models.moments_table(spark, found, second)))[0]
    return spark.createDataFrame([(c, round(w, 6), kept[c][1]) for c, w in models.classes(kept)], "class string, weight double, n long")


def q_axis_words(spark, sf):
    """Words on either side of the axis between facts that a strengthening and a forgetting touched."""
    e, v = episodes(spark, sf), trained(spark, sf)
    scopes = e.select("scope").distinct()
    touched = semantic.outcome_texts(e, scopes.withColumn("match", F.lit("the ")), "+").unionByName(semantic.outcome_texts(e, scopes.withColumn("match", F.lit("on ")), "-"))
    rows = semantic.embedded(touched, v, ["scope", "idx", "class"], "t")
    found = discriminant.axis(*discriminant.class_moments(rows), "+", "-")
    words = vectors.dense(v, ["word"]).withColumnRenamed("word", "id")
    if found is None:
        return words.select(F.lit("+").alias("side"), F.lit(1).alias("rank"), "id", F.lit(0.0).alias("cosine")).limit(0)
    return semantic.axis_words(words, found[0], 5)


def q_spread_across(spark, sf):
    e = episodes(spark, sf)
    child = e.withColumn("scope", F.concat(F.lit("all__"), "scope"))
    q = last_sentences(e).select("qid", F.lit("all").alias("scope"), "query")
    return graph.spread_across(q, child, 5, 1).select("qid", "rank", "scope", "idx", "seed", F.round("act", 6).alias("act"))


def q_spread_trusted(spark, sf):
    """One hop, ranked again by the trust of each fact's class: its conversation's."""
    e = episodes(spark, sf)
    ledger = signals.trust(trust_rounds(spark, sf).withColumn("class", (F.col("round") % 100).cast("string")))
    return graph.spread_trusted(last_sentences(e), e, ledger, 5, 1).select("qid", "rank", "idx", F.round("act", 6).alias("act"))


def assigned(spark, sf) -> DataFrame:
    m = messages(spark, sf).select(F.concat_ws("/", "scope", "seq").alias("id"), "text")
    return cut(topics.token_topics(m, 8, 6))


def q_top_words(spark, sf):
    return topics.top_words(assigned(spark, sf), 8).withColumn("phi", F.round("phi", 9))


def q_fold_in(spark, sf):
    """Topics of each conversation's last message under counts that stay as they are."""
    last = last_messages(spark, sf).select(F.col("qid").alias("id"), F.col("query").alias("text"))
    return topics.fold_in(last, assigned(spark, sf), 8)


def q_topic_gate(spark, sf):
    """Facts that each conversation's last message may mean, by topics of its words and of itself."""
    a = assigned(spark, sf)
    f = messages(spark, sf).select(F.concat_ws("/", "scope", "seq").alias("id"), "scope", F.col("seq").alias("idx"))
    return topics.topic_gate(last_messages(spark, sf), a, f, 8).groupBy("qid").agg(F.count(F.lit(1)).alias("n"), F.min("idx").alias("first"))


def q_scope_topics(spark, sf):
    f = messages(spark, sf).select(F.concat_ws("/", "scope", "seq").alias("id"), "scope")
    return topics.scope_topics(assigned(spark, sf), f).withColumn("share", F.round("share", 9))


def _session(spark, sf):
    from .catalog import q_session

    return cut(q_session(spark, sf))


def q_related(spark, sf):
    """The facts most strongly linked to each recalled one."""
    hits = _session(spark, sf)
    weights = hits.groupBy("scope", "idx").agg(F.max("weight").alias("eff"))
    return adaptive.related(hits.select("qid", "scope", "idx"), adaptive.recall_links(hits), weights, 3).select("qid", "scope", "rank", "idx", F.round("w", 6).alias("w"))


def q_spread_links(spark, sf):
    hits = _session(spark, sf)
    weights = hits.groupBy("scope", "idx").agg(F.max("weight").alias("eff"))
    seeds = hits.where("tick = 0").select("qid", "scope", "idx", F.lit(1.0).alias("act"))
    return adaptive.spread_links(seeds, adaptive.recall_links(hits), weights, 2, 5)


QUERIES = {
    "semantic_totals": q_totals, "vector_nearest": q_nearest, "recall_semantic": q_semantic, "recall_blended": q_blended, "recall_durable": q_durable,
    "axis_project": q_axis_rank, "discriminant_classes": q_classes, "axis_words": q_axis_words, "spread_across": q_spread_across,
    "spread_trusted": q_spread_trusted, "topic_top_words": q_top_words, "topic_fold_in": q_fold_in, "topic_gate": q_topic_gate,
    "topic_scopes": q_scope_topics, "adaptive_related": q_related, "adaptive_spread": q_spread_links,
}
