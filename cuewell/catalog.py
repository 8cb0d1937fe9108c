"""Every registered query of the core library and its DuckDB SQL.

Each query runs one operator over whole tables: conversations as facts (a scope per conversation),
rendered orders as facts (one large scope), documents as text, events as ordered input, embeddings
as ready vectors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .functions import text as T
from .operators import across, adaptive, discriminant, graph, links, recall, secure, signals, store, topics, turns, vectors
from .operators.encode import encode
from .plans.lineage import cut, written
from .sources import packs


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def messages(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").select(F.col("conv_id").cast("string").alias("scope"), F.col("turn").alias("seq"), "role", "text")


def sentences(spark: SparkSession, sf: str) -> DataFrame:
    return messages(spark, sf).select("scope", "seq", F.posexplode(T.sentences(F.col("text"))).alias("pos", "t"))


def facts(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations as facts: every declarative sentence, in order."""
    return store.observe(messages(spark, sf))


def episodes(spark: SparkSession, sf: str) -> DataFrame:
    """The same facts encoded, written once for all that reads them."""
    return written(store.observe_encoded(messages(spark, sf)))


def order_facts(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as facts of one scope: their words are shared by all, their numbers by none."""
    o = table(spark, sf, "orders")
    lines = F.array(
        F.concat(F.lit("the status of order "), F.col("o_orderkey"), F.lit(" is "), F.col("o_orderstatus"), F.lit("tatus")),
        F.concat(F.lit("the customer of order "), F.col("o_orderkey"), F.lit(" is Customer"), F.col("o_custkey")),
    )
    return o.select(F.lit("orders").alias("scope"), "o_orderkey", F.posexplode(lines).alias("p", "t")).select("scope", (F.col("o_orderkey") * 2 + F.col("p")).alias("idx"), "t", F.lit(1.0).alias("strength"), F.lit(None).cast("string").alias("key"))


def last_sentences(f: DataFrame) -> DataFrame:
    """One query for each conversation: its last sentence, asked of the conversation."""
    last = f.groupBy("scope").agg(F.max_by("t", "idx").alias("query"))
    return last.select(F.col("scope").cast("long").alias("qid"), "scope", "query")


def q_sentences(spark, sf):
    return sentences(spark, sf)


def q_words(spark, sf):
    """All text primitives over every distinct token of all documents."""
    tok = table(spark, sf, "documents").select(F.explode(T.tokens(F.coalesce("text", F.lit("")))).alias("token")).distinct()
    t = F.col("token")
    return tok.select("token", T.clean_word(t).alias("word"), T.clip(t).alias("clipped"), T.stem(T.clean_word(t)).alias("stem"), T.root(t).alias("root"), T.canon(t).alias("canon"), T.is_number(t).alias("number"))


def q_content(spark, sf):
    m = messages(spark, sf)
    return m.select("scope", "seq", F.array_join(F.array_sort(T.content(F.col("text"))), " ").alias("content"), F.array_join(T.cue(F.col("text")), " ").alias("cue"), T.prose_like(F.col("text")).alias("prose"))


def q_semantic_tokens(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", F.array_join(T.semantic_tokens(F.col("text")), " ").alias("tokens"), F.size(T.norm_words(F.col("text"))).cast("long").alias("n_words"))


def q_encode(spark, sf):
    e = store.observe_encoded(messages(spark, sf))
    return e.select("scope", "idx", "t", "v", F.array_join("c", "|").alias("c"), F.array_join("s", "|").alias("s"), F.array_join("raw", "|").alias("raw"), F.array_join(F.transform("pos", lambda x: x.cast("string")), "|").alias("pos"), "head", "self_flag")


def q_postings(spark, sf):
    return recall.document_counts(episodes(spark, sf))


def q_catalog(spark, sf):
    return store.catalog(facts(spark, sf))


def q_page(spark, sf):
    p = store.page(facts(spark, sf), 2, 3)
    return p.select("scope", "total", "start", F.array_join("facts", "\n").alias("facts"))


def q_neighbours(spark, sf):
    f = facts(spark, sf)
    hits = f.select((F.row_number().over(Window.partitionBy("scope").orderBy("idx")) - 1).alias("qid"), "scope", F.lit(1).alias("rank"), "idx")
    n = recall.neighbours(hits, f, 2, 3)
    return n.select("scope", "idx", "start", F.array_join("facts", "\n").alias("facts"))


def q_stats(spark, sf):
    return store.stats(facts(spark, sf), 5)


def q_drain(spark, sf):
    return store.drain(facts(spark, sf), 3)[0].select("scope", "idx", "t")


def q_dedup(spark, sf):
    f = facts(spark, sf)
    users = f.where("idx % 2 = 0").select("scope", "t")
    return store.drop_known(users, f.where("idx % 2 = 1"), 4).groupBy("scope").agg(F.count(F.lit(1)).alias("fresh"))


def q_forget(spark, sf):
    return store.forget(facts(spark, sf), F.lit("THE ")).select("scope", "idx", "t")


def q_forget_prefix(spark, sf):
    return store.forget_prefix(facts(spark, sf), F.lit("The")).select("scope", "idx", "t")


def q_strengthen(spark, sf):
    f = facts(spark, sf)
    m = f.groupBy("scope").agg(F.min_by("t", "idx").alias("m")).select("scope", F.left("m", F.lit(6)).alias("match"), F.lit(2.5).alias("bump"))
    return store.strengthen(f, m).select("scope", "idx", "strength")


def q_decay(spark, sf):
    f = facts(spark, sf).withColumn("strength", (F.col("idx") % 5) * 0.75)
    return store.decay_others(f, F.lit("the"), 0.9, 0.5).select("scope", "idx", F.round("strength", 6).alias("strength"))


def events_keyed(spark, sf):
    e = table(spark, sf, "events")
    return e.select(F.col("user_id").cast("string").alias("scope"), F.col("event_id").alias("seq"), F.col("event_type").alias("key"), F.concat(F.lit("the last "), "event_type", F.lit(" value is "), F.round("value", 2).cast("decimal(18,2)").cast("string")).alias("text"))


def q_upsert(spark, sf):
    """Keyed facts of every user: the last event of each type."""
    none = facts(spark, sf).limit(0)
    return store.upsert(none, events_keyed(spark, sf)).select("scope", "idx", "t", "key")


def q_forget_key(spark, sf):
    f = store.upsert(facts(spark, sf).limit(0), events_keyed(spark, sf))
    return store.forget_key(f, f.where("key = 'click'").select("scope", "key").distinct())


def q_variables(spark, sf):
    e = events_keyed(spark, sf)
    v = store.set_variables(facts(spark, sf).limit(0), e.select("scope", "seq", F.col("key").alias("name"), F.substring_index("text", " is ", -1).alias("value")))
    return store.get_variables(v, v.select("scope", F.substring_index("t", " is ", 1).alias("name")).distinct())


def q_dump(spark, sf):
    return store.dump(facts(spark, sf)).select("scope", F.md5("blob").alias("md5"), F.length("blob").cast("long").alias("n"))


def q_interned(spark, sf):
    return store.interned_bytes(facts(spark, sf))


def q_recall(spark, sf):
    e = episodes(spark, sf)
    return recall.recall(last_sentences(e), e).select("qid", "fact", "idx", F.round("coverage", 9).alias("coverage"), "overlap", "exact")


def q_recall_value(spark, sf):
    e = episodes(spark, sf)
    return recall.recall(last_sentences(e), e).select("qid", "scope", "value", "echo")


def q_recall_many(spark, sf):
    e = episodes(spark, sf)
    return recall.recall_many(last_sentences(e), e, 5).select("qid", "rank", "idx", F.round("coverage", 9).alias("coverage"), "overlap", "exact")


def q_recall_orders(spark, sf):
    """A question about every order, in one scope whose hub stems every fact shares."""
    q = table(spark, sf, "orders").select(F.col("o_orderkey").alias("qid"), F.lit("orders").alias("scope"), F.concat(F.lit("what is the status of order "), F.col("o_orderkey")).alias("query"))
    e = written(encode(order_facts(spark, sf).repartition("idx")))
    return recall.recall(q, e).select("qid", "idx", "value", "overlap", "exact")


def q_spread(spark, sf):
    e = episodes(spark, sf)
    s = graph.spread(last_sentences(e), e, 8, 1)
    return s.select("qid", "rank", "idx", "seed", F.round("act", 6).alias("act"))


def q_spread_settled(spark, sf):
    e = episodes(spark, sf)
    return graph.spread(last_sentences(e), e, 8, 0).select("qid", "rank", "idx", "seed", F.round("act", 6).alias("act"))


def geography(spark, sf):
    """Customers, nations and regions as facts of one scope."""
    c, n = (table(spark, sf, x) for x in ("customer", "nation"))
    name = lambda kind, key: F.concat(F.lit(kind), F.col(key))
    rows = c.select(F.col("c_custkey").alias("idx"), F.concat(name("Cu", "c_custkey"), F.lit(" nation is "), name("Na", "c_nationkey")).alias("t"))
    rows = rows.unionByName(n.select((-1 - F.col("n_nationkey")).cast("long").alias("idx"), F.concat(name("Na", "n_nationkey"), F.lit(" region is "), name("Re", "n_regionkey")).alias("t")))
    return rows.select(F.lit("geo").alias("scope"), "idx", "t", F.lit(1.0).alias("strength"), F.lit(None).cast("string").alias("key"))


def q_chain(spark, sf):
    """Customer to nation to region, two hops for every customer."""
    c = table(spark, sf, "customer")
    starts = c.select(F.col("c_custkey").alias("qid"), F.lit("geo").alias("scope"), F.concat(F.lit("Cu"), F.col("c_custkey")).alias("start"), F.array(F.lit("nation"), F.lit("region")).alias("path"))
    out = recall.chain(starts, written(encode(geography(spark, sf).repartition("idx"))), 2)
    return out.select("qid", "value", F.array_join("trail", ">").alias("trail"))


def q_sharded(spark, sf):
    e = episodes(spark, sf)
    return recall.recall_sharded(last_sentences(e), e, 4).select("qid", "idx", "overlap", "exact", "shard")


def q_assess(spark, sf):
    e = episodes(spark, sf)
    a = recall.assess(last_sentences(e), e)
    return a.select("qid", F.round("coverage", 9).alias("coverage"), "overlap", "exact", "n_hits")


def q_context(spark, sf):
    e = episodes(spark, sf)
    c = recall.recall_context(last_sentences(e), e, e, 3, 1, 1)
    return c.select("qid", "rank", "start", "hit_pos", F.array_join("facts", "\n").alias("facts"))


def q_contested(spark, sf):
    e = episodes(spark, sf)
    q = last_sentences(e)
    return signals.contested(recall.recall_many(q, e, 4), q)


def trust_rounds(spark, sf):
    e = table(spark, sf, "events")
    return e.select(F.col("event_id").alias("round"), F.col("event_type").alias("class"), (F.col("value") / 100 - 0.5).alias("delta"))


def q_trust(spark, sf):
    t = signals.trust(trust_rounds(spark, sf))
    return t.select("class", F.round("weight", 6).alias("weight"), "rewards", "penalties")


def q_trust_rank(spark, sf):
    ledger = signals.trust(trust_rounds(spark, sf))
    e = table(spark, sf, "events").select(F.col("user_id").alias("qid"), F.col("event_id").alias("pos"), F.col("value").alias("relevance"), F.col("event_type").alias("class"))
    return signals.trust_rank(e, ledger).select("qid", "pos", "class", "rank")


def notes(spark, sf):
    e = table(spark, sf, "events")
    return e.select(F.col("user_id").cast("string").alias("scope"), F.col("event_id").alias("seq"), F.col("event_type").alias("topic"), F.concat(F.lit("felt "), F.col("event_id").cast("string")).alias("feeling"))


def q_stances(spark, sf):
    return signals.stances(notes(spark, sf)).select("scope", "topic", "feeling", F.round("strength", 6).alias("strength"))


def q_persona(spark, sf):
    p = {"openness": 0.9, "conscientiousness": 0.8, "neuroticism": 0.7, "reactivity": 1.5}
    return signals.stances(notes(spark, sf), p).select("scope", "topic", F.round("strength", 6).alias("strength"))


def q_directive(spark, sf):
    n = notes(spark, sf)
    moods = n.groupBy("scope").agg(F.max_by("feeling", "seq").alias("mood"), F.min("topic").alias("asked"))
    return signals.directive(moods, signals.stances(n))


def q_class_of(spark, sf):
    m = messages(spark, sf)
    tagged = F.when(F.col("seq") % 3 == 0, F.concat(F.lit("[src:"), "role", F.lit(" note] "), "text")).when(F.col("seq") % 3 == 1, F.concat(F.lit("[vega r"), F.col("seq").cast("string"), F.lit("] "), "text")).otherwise(F.col("text"))
    return m.select("scope", "seq", signals.class_of(tagged, F.col("scope")).alias("class"))


def q_cosine(spark, sf):
    """Ten nearest vectors by cosine of every vector whose id is divisible by 20."""
    v = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.transform("embedding", lambda x: x.cast("double")).alias("vec"))
    near = vectors.nearest(v, v.where("id % 20 = 0").withColumnRenamed("id", "qid"), 10)
    return near.select("qid", "rank", "id", F.round("cosine", 6).alias("cosine"))


def q_quantize(spark, sf):
    e = table(spark, sf, "embeddings")
    z = e.select("vec_id", vectors.quantize(F.col("embedding")).alias("z"))
    return z.select("vec_id", F.array_join(F.transform("z.q", lambda x: x.cast("string")), ",").alias("q"), F.round("z.scale", 9).alias("scale"))


def q_cooccurrence(spark, sf):
    return vectors.cooccurrence(messages(spark, sf))


def q_context_vectors(spark, sf):
    return vectors.train(messages(spark, sf))


def q_axis(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("vec"), F.when(F.col("label") < 5, "low").otherwise("high").alias("class"))
    found = discriminant.axis(*discriminant.class_moments(e), "low", "high")
    if found is None:
        return e.select("vec_id", F.lit(0.0).alias("z"), "class").limit(0)
    return e.select("vec_id", discriminant.axis_score(F.col("vec"), *found).alias("z"), "class")


def q_kmeans(spark, sf):
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.transform("embedding", lambda x: x.cast("double")).alias("vec"))
    return vectors.kmeans(e, 8, 4)


def q_project(spark, sf):
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.transform("embedding", lambda x: x.cast("double")).alias("vec"))
    return vectors.project(e, 3)[0]


def q_fusion(spark, sf):
    """Two rankings of each user's events fused: by value and by recency."""
    e = table(spark, sf, "events").select(F.col("user_id").alias("qid"), F.col("event_id").alias("item"), "value")
    by = lambda *o: e.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(*o))).select("qid", "item", "rank")
    out = recall.rank_fusion([by(F.desc("value"), "item"), by(F.desc("item"))], ["qid"], "item", 5)
    return out.select("qid", "rank", "item", F.round("score", 9).alias("score"))


def q_turns(spark, sf):
    return turns.classify(messages(spark, sf)).select("scope", "seq", "kind", "yes_no")


def q_route(spark, sf):
    e = episodes(spark, sf)
    return turns.route(recall.assess(last_sentences(e), e)).groupBy("route").agg(F.count(F.lit(1)).alias("n"))


def q_links(spark, sf):
    """Each order linked to its customer: partners of every end."""
    o = table(spark, sf, "orders")
    rows = o.select(F.col("o_orderkey").alias("id"), F.lit("orders").alias("src_scope"), F.concat(F.lit("order "), F.col("o_orderkey")).alias("src_text"), F.lit("customers").alias("dst_scope"), F.concat(F.lit("customer "), F.col("o_custkey")).alias("dst_text"), F.lit("copy").alias("classical"), F.lit(1).alias("ebits"))
    ends = rows.select(F.col("dst_scope").alias("scope"), F.col("dst_text").alias("t")).distinct()
    return links.find(rows, ends).select("scope", "t", "id", "partner")


def q_invert(spark, sf):
    e = table(spark, sf, "events")
    return e.select("event_id", links.invert(F.col("event_type")).alias("word"), links.invert(F.col("event_id").cast("string")).alias("number"))


def q_measure(spark, sf):
    e = table(spark, sf, "events").groupBy("user_id").agg(F.array_sort(F.collect_set("event_type")).alias("alts"))
    alts = F.transform("alts", lambda a: F.struct(a.alias("alt"), F.lit(1.0).alias("w")))
    m = e.select("user_id", links.measure(alts, F.lit(3)).alias("m"))
    return m.select("user_id", "m.chosen", F.size("m.rest").alias("left"))


def q_reads(spark, sf):
    e = table(spark, sf, "events").select(F.col("user_id").cast("string").alias("scope"), F.col("event_type").alias("t"), F.col("event_id").alias("seq"))
    budget = e.select("scope", "t").distinct().withColumn("reads", F.lit(2))
    return links.spend_reads(budget, e)[0].groupBy("scope", "t").agg(F.sum(F.col("served").cast("long")).alias("served"))


def q_consolidate(spark, sf):
    e = episodes(spark, sf)
    w = e.select("scope", "idx", ((F.col("idx") % 4) * 0.5).alias("eff"))
    return adaptive.consolidate(e, w, 0.4).select("scope", "idx", "merged", F.round("eff", 6).alias("eff"))


def q_session(spark, sf):
    """Each conversation's sentences recalled in order, every hit strengthening its fact."""
    e = episodes(spark, sf)
    q = e.select(F.col("idx").cast("long").alias("qid"), "scope", F.col("idx").alias("seq"), F.col("t").alias("query"))
    return adaptive.recall_session(q, e, 8.0).withColumn("weight", F.round("weight", 9))


def q_session_links(spark, sf):
    return adaptive.recall_links(q_session(spark, sf))


def q_pack(spark, sf):
    """Conversations as pack lines, a heading before each, read back."""
    m = sentences(spark, sf)
    head = m.select("scope").distinct().select("scope", F.lit(-1).cast("long").alias("seq"), F.lit(0).alias("pos"), F.concat(F.lit("# scope: c"), "scope").alias("text"))
    both = head.unionByName(m.select("scope", F.col("seq").cast("long").alias("seq"), "pos", F.col("t").alias("text")))
    lines = both.select(F.col("scope").alias("file"), F.row_number().over(Window.partitionBy("scope").orderBy("seq", "pos")).alias("line"), "text")
    return packs.import_pack(lines).select("scope", "line", "t")


def q_across(spark, sf):
    """Documents as sub-scopes of their source; each source is asked its first document's first sentence."""
    d = table(spark, sf, "documents").where(F.col("text").isNotNull())
    m = d.select(F.concat_ws("__", "source", F.col("doc_id").cast("string")).alias("scope"), F.lit(0).alias("seq"), "text")
    source, doc = F.split("scope", "__")[0], F.split("scope", "__")[1].cast("long")
    # A source's first document with a fact is looked for among its first few, then among more.
    order = Window.partitionBy(source).orderBy(doc)
    n, most = m.groupBy(source.alias("b")).count().agg(F.count(F.lit(1)), F.max("count")).first()
    few = 4
    while True:
        near = m.select("scope").withColumn("r", F.rank().over(order)).where(F.col("r") <= few).select("scope").distinct()
        near = F.broadcast(near) if few * n <= 10_000 else near
        firsts = store.observe_encoded(m.join(near, "scope", "left_semi")).where("idx = 0")
        q = written(firsts.groupBy(source.alias("scope")).agg(F.min_by("t", doc).alias("query")))
        if few >= (most or 0) or q.count() == n:
            break
        few *= 16
    q = q.select(F.regexp_extract("scope", "([0-9]+)$", 1).cast("long").alias("qid"), "scope", "query")
    return across.best_across(q, m, 5, messages=True).select("qid", "rank", "scope", "idx", "overlap", "exact")


def q_secure(spark, sf):
    """Each user's event values stored encrypted under a phrase, and asked back by it."""
    e = events_keyed(spark, sf)
    rows = e.select("scope", "seq", F.concat(F.lit("the last "), "key", F.lit(" value")).alias("phrase"), F.substring_index("text", " is ", -1).alias("value"))
    asked = e.groupBy("scope", "key").agg(F.max("seq").alias("qid")).select("qid", "scope", F.concat(F.lit("what is the last "), "key", F.lit(" value")).alias("query"))
    return secure.get(asked, secure.put(rows, b"an example secret"), b"an example secret").select("qid", "scope", "value")


def q_topics(spark, sf):
    m = messages(spark, sf).select(F.concat_ws("/", "scope", "seq").alias("id"), "text")
    return topics.mixture(topics.token_topics(m, 8, 6), 8).withColumn("share", F.round("share", 9))


def q_teleport(spark, sf):
    """Every order's fact moved over its link to its customer's."""
    o = table(spark, sf, "orders")
    fact = F.concat(F.lit("order "), F.col("o_orderkey"), F.lit(" is "), F.col("o_orderstatus"))
    how = F.when(F.col("o_orderkey") % 2 == 0, "copy").otherwise("invert")
    made = o.select(F.col("o_orderkey").alias("id"), F.lit("orders").alias("src_scope"), fact.alias("src_text"), F.lit("customers").alias("dst_scope"), F.concat(F.lit("customer "), F.col("o_custkey")).alias("dst_text"), how.alias("classical"), F.lit(2).alias("ebits"))
    asked = o.select(F.col("o_orderkey").alias("qid"), F.lit("orders").alias("scope"), fact.alias("fact"), F.col("o_orderkey").cast("string").alias("value"))
    return links.teleport(asked, made).select("qid", "dst_fact", "value", "ebits_left")


QUERIES = {
    "text_sentences": q_sentences, "text_words": q_words, "text_content": q_content, "text_semantic_tokens": q_semantic_tokens,
    "encode_facts": q_encode, "index_postings": q_postings, "scan_catalog": q_catalog, "scan_page": q_page, "scan_neighbours": q_neighbours,
    "scope_stats": q_stats, "write_drain": q_drain, "write_dedup": q_dedup, "write_forget": q_forget, "write_forget_prefix": q_forget_prefix,
    "write_strengthen": q_strengthen, "write_decay": q_decay, "write_upsert": q_upsert, "write_forget_key": q_forget_key, "write_variables": q_variables,
    "write_dump": q_dump, "interned_bytes": q_interned, "recall_top1": q_recall, "recall_value": q_recall_value, "recall_many": q_recall_many,
    "recall_orders": q_recall_orders, "recall_chain": q_chain, "recall_sharded": q_sharded, "recall_assess": q_assess, "recall_context": q_context,
    "spread_one_hop": q_spread, "spread_settled": q_spread_settled, "rank_fusion": q_fusion, "contested_marks": q_contested, "trust_fold": q_trust,
    "trust_rank": q_trust_rank, "trust_class": q_class_of, "stance_fold": q_stances, "stance_persona": q_persona, "affect_directive": q_directive,
    "vector_cosine": q_cosine, "vector_quantize": q_quantize, "vector_cooccurrence": q_cooccurrence, "vector_context": q_context_vectors,
    "vector_kmeans": q_kmeans, "vector_project": q_project, "discriminant_axis": q_axis, "turn_classify": q_turns, "turn_route": q_route,
    "link_partners": q_links, "link_invert": q_invert, "link_measure": q_measure, "link_reads": q_reads, "adaptive_consolidate": q_consolidate,
    "adaptive_session": q_session, "adaptive_links": q_session_links, "pack_import": q_pack, "recall_across": q_across, "secure_values": q_secure, "topic_mixture": q_topics, "link_teleport": q_teleport,
}


def entry(spark: SparkSession, sf: str) -> DataFrame:
    return QUERIES["recall_top1"](spark, sf)


def queries() -> dict:
    from . import catalog_meaning, catalog_store

    return QUERIES | catalog_store.QUERIES | catalog_meaning.QUERIES


def oracle_sql() -> dict[str, str]:
    from .plans import oracle, oracle_meaning, oracle_store

    known = queries()
    return {k: v for k, v in (oracle.SQL | oracle_store.SQL | oracle_meaning.SQL).items() if k in known}
