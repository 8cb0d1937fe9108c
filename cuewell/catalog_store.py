"""Registered queries over writes, logs, variables, links, personas and stored models."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .catalog import episodes, events_keyed, facts, last_sentences, messages, notes, sentences, table, trust_rounds
from .functions import text as T
from .functions.hashing import fact_key, sampled
from .operators import adaptive, links, models, recall, signals, store, turns
from .operators import index as stored
from .operators.encode import encode
from .plans.lineage import cut, folder, written
from .sources import packs
from .streaming import capture


def q_hashes(spark, sf):
    p = table(spark, sf, "part")
    text = F.concat_ws(" - ", "p_name", "p_brand", "p_type")
    return p.select("p_partkey", fact_key(text).alias("key"), sampled(text).alias("sampled"))


def q_escapes(spark, sf):
    e = table(spark, sf, "events")
    coded = F.concat(F.lit("q="), F.replace("event_type", F.lit("e"), F.lit("%65")), F.lit("+no.%20"), F.col("event_id"))
    return e.select("event_id", T.json_escape(F.concat("props", F.lit("\t\\"))).alias("escaped"), T.url_decode(coded).alias("decoded"))


def q_scan(spark, sf):
    return store.scan(facts(spark, sf).where("idx % 3 <> 1"))


def q_episodes(spark, sf):
    e = episodes(spark, sf)
    return e.select("scope", "idx", "t", "v", F.size("cand").alias("candidates"), "strength")


def q_updates(spark, sf):
    return store.by_update(messages(spark, sf))


def q_has_fact(spark, sf):
    """First sentences of every conversation, asked of every other fact."""
    f = facts(spark, sf)
    return store.has_fact(f.where("idx % 2 = 0"), sentences(spark, sf).where("pos <= 1").select("scope", "t").distinct())


def q_replay(spark, sf):
    """A snapshot of each conversation's first ten facts and a log of the others, read as one."""
    f = facts(spark, sf)
    log = f.where("idx >= 10").withColumn("seq", F.col("idx") * 7)
    return store.replay(f.where("idx < 10"), log).select("scope", "idx", "t")


def q_compact(spark, sf):
    """Users' events as a log over a snapshot of their first ones: whose log is due, and what is left of it."""
    e = table(spark, sf, "events").select((F.col("user_id") % 20).cast("string").alias("scope"), F.col("event_id").alias("seq"), "event_type")
    rows = e.select("scope", "seq", F.concat(F.lit("event "), "seq", F.lit(" is "), "event_type").alias("t"), F.lit(1.0).alias("strength"), F.lit(None).cast("string").alias("key"))
    low = rows.where("seq % 4 = 0 AND scope < '3'")
    order = Window.partitionBy("scope").orderBy("seq")
    snapshot = low.withColumn("idx", F.row_number().over(order) - 1)
    log = rows.join(low.select("scope", "seq"), ["scope", "seq"], "left_anti")
    whole, rest = store.compact(snapshot, log)
    a = whole.groupBy("scope").agg(F.count(F.lit(1)).alias("stored"))
    b = rest.groupBy("scope").agg(F.count(F.lit(1)).alias("logged"))
    return a.join(b, "scope", "full").select("scope", F.coalesce("stored", F.lit(0)).alias("stored"), F.coalesce("logged", F.lit(0)).alias("logged"))


def q_durable(spark, sf):
    """Every message written twice: one that a stored fact says word for word adds nothing."""
    m = messages(spark, sf).select("scope", "seq", "text")
    twice = m.unionByName(m.withColumn("seq", F.col("seq") + 1000))
    return store.observe_durable(twice, facts(spark, sf).limit(0)).select("scope", "idx", "t")


def q_load(spark, sf):
    f = facts(spark, sf).withColumn("key", F.when(F.col("idx") % 4 == 0, F.concat(F.lit("k\t"), "idx")))
    return store.load(store.dump(f)).select("scope", F.col("idx").cast("long").alias("idx"), "t", "key", "strength")


def q_pack_blob(spark, sf):
    blobs = store.unpack(store.pack(store.dump(facts(spark, sf))))
    return blobs.select("scope", F.md5("blob").alias("md5"), F.length("blob").cast("long").alias("n"))


def q_wipe(spark, sf):
    """Conversations and typed sub-scopes of theirs; those of even number are wiped."""
    f = facts(spark, sf)
    kinds = f.where("idx < 7").withColumn("scope", F.concat("scope", F.element_at(F.array(*[F.lit(x) for x in ("::var", "::instr", "::stance", "::affect", "::persona", "__doc", "::other")]), (F.col("idx") + 1).cast("int"))))
    every = f.unionByName(kinds)
    gone = f.where("CAST(scope AS LONG) % 2 = 0").select("scope").distinct()
    return store.wipe(every, gone).groupBy("scope").agg(F.count(F.lit(1)).alias("facts"))


def q_replace(spark, sf):
    f = facts(spark, sf)
    new = f.where("CAST(scope AS LONG) % 3 = 0 AND idx < 2").withColumn("t", F.concat(F.lit("again "), "t"))
    return store.replace_scopes(f, new).select("scope", "idx", "t")


def q_import(spark, sf):
    """A pack with every second fact of a conversation and a new one, written after what is held."""
    f = facts(spark, sf)
    held = f.where("idx % 2 = 0")
    extra = f.where("idx = 0").select("scope", F.lit(-1).cast("long").alias("line"), F.lit("the pack holds one more fact").alias("t"))
    pack = f.select("scope", F.col("idx").cast("long").alias("line"), "t").unionByName(extra).withColumns({"file": F.lit("p"), "key": F.lit(None).cast("string")})
    return packs.import_into(held, pack).select("scope", "idx", "t")


def q_rewrite(spark, sf):
    f = facts(spark, sf).withColumn("strength", F.col("idx") + 0.5)
    c = f.where("idx % 5 = 0").select("scope", F.col("t").alias("old"), F.concat(F.lit("rewritten fact number "), "idx").alias("new"))
    c = c.unionByName(f.where("idx = 1").select("scope", F.lit("no such fact").alias("old"), F.lit("nothing comes of it").alias("new")))
    return store.rewrite(f, c).select("scope", "idx", "t", "strength")


def q_reinforce(spark, sf):
    """Each user's topics noted once, then the one of the last event again."""
    n = notes(spark, sf)
    last = n.groupBy("scope").agg(F.max_by(F.struct("topic", "feeling"), "seq").alias("x")).select("scope", "x.topic", "x.feeling")
    first = n.groupBy("scope", "topic").agg(F.min_by("feeling", "seq").alias("feeling"))
    written = signals.reinforce(facts(spark, sf).limit(0), first)
    return signals.reinforce(cut(written), last.withColumn("topic", F.upper("topic")), 0.5).select("scope", "idx", "t", "strength")


def instruction_rows(spark, sf) -> DataFrame:
    e = table(spark, sf, "events")
    text = F.when(F.col("event_id") % 7 == 0, F.lit("")).otherwise(F.concat(F.lit("Always "), "event_type", F.lit(" number "), F.col("event_id") % 4))
    return e.select(F.col("user_id").cast("string").alias("scope"), F.col("event_id").alias("seq"), text.alias("text"))


def q_instructions(spark, sf):
    return store.instructions(instruction_rows(spark, sf))


def q_instructions_deleted(spark, sf):
    held = store.instructions(instruction_rows(spark, sf))
    needles = held.select("scope").distinct().withColumn("needle", F.lit(" CLICK "))
    left, _ = store.delete_instructions(held, needles.unionByName(needles.withColumn("needle", F.lit(""))))
    kept, _ = store.clear_instructions(left, held.where("CAST(scope AS LONG) % 2 = 0").select("scope").distinct())
    return kept


def variable_facts(spark, sf) -> DataFrame:
    e = events_keyed(spark, sf)
    return store.set_variables(facts(spark, sf).limit(0), e.select("scope", "seq", F.col("key").alias("name"), F.substring_index("text", " is ", -1).alias("value")))


def q_variables_list(spark, sf):
    return store.variables(variable_facts(spark, sf))


def q_variables_deleted(spark, sf):
    v = variable_facts(spark, sf)
    scopes = v.select("scope").distinct()
    names = scopes.withColumn("name", F.lit("CLICK")).unionByName(scopes.withColumn("name", F.lit("no such name")))
    left, told = store.delete_variables(v, names)
    n = left.groupBy("scope").agg(F.count(F.lit(1)).alias("held"))
    return told.join(n, "scope", "left").select("scope", "name", "deleted", F.coalesce("held", F.lit(0)).alias("held"))


def q_scored(spark, sf):
    """Orders' statuses recalled while some of them are contested by a later claim."""
    o = order_rows(spark, sf)
    marks = order_marks(spark, sf)
    hits = o.select("qid", "scope", F.lit(1).alias("rank"), F.col("t").alias("fact"))
    return signals.scored(hits, marks).select("qid", "contested", "with")


def order_rows(spark, sf) -> DataFrame:
    o = table(spark, sf, "orders")
    return o.select(F.col("o_orderkey").alias("qid"), F.lit("orders").alias("scope"), F.concat(F.lit("the status of order "), F.col("o_orderkey"), F.lit(" is "), F.col("o_orderstatus"), F.lit("tatus")).alias("t"))


def order_marks(spark, sf) -> DataFrame:
    """What claims about every order leave as marks: a denial, another value, or the same again, in turn."""
    o = order_rows(spark, sf)
    said = F.when(F.col("qid") % 3 == 0, F.regexp_replace("t", " is ", " is not ")).when(F.col("qid") % 3 == 1, F.regexp_replace("t", " is .*", " is changed")).otherwise(F.upper("t"))
    hits = o.select("qid", "scope", F.col("t").alias("fact"), F.lit(0.9).alias("coverage"), F.lit(3).alias("overlap"))
    return signals.observe_checked(o.select("qid", said.alias("query")), hits)


def q_checked(spark, sf):
    return order_marks(spark, sf)


def q_stored_marks(spark, sf):
    """Marks written as variables of a sub-scope and read back."""
    held = store.set_variables(facts(spark, sf).limit(0), signals.marks_as_variables(order_marks(spark, sf)))
    return signals.stored_marks(held)


def q_samples(spark, sf):
    """How many of the facts about each nation's customers are sampled."""
    from .catalog import geography
    from .operators.semantic import scope_samples

    f = geography(spark, sf).withColumn("scope", F.concat(F.regexp_extract("t", " is (.*)$", 1), F.lit("__c")))
    return scope_samples(f).groupBy("class").agg(F.count(F.lit(1)).alias("n"))


def keyed_facts(spark, sf) -> DataFrame:
    return cut(store.upsert(facts(spark, sf).limit(0), events_keyed(spark, sf)))


def q_keyed(spark, sf):
    """Each user's keyed facts asked for the last click, with the keys of what comes back."""
    f = keyed_facts(spark, sf)
    q = f.select("scope").distinct().select(F.col("scope").cast("long").alias("qid"), "scope", F.lit("what is the last click value").alias("query"))
    hits = recall.recall_many(q, cut(encode(f)), 3)
    return recall.keyed_hits(hits, f).select("qid", "rank", "idx", "key", "overlap")


def q_why(spark, sf):
    """Each user's view of the topic of their first event, with the facts about it."""
    n = notes(spark, sf)
    f = keyed_facts(spark, sf)
    topics = n.groupBy("scope").agg(F.min_by("topic", "seq").alias("topic")).select(F.col("scope").cast("long").alias("qid"), "scope", "topic")
    hits = recall.recall_many(topics.select("qid", "scope", F.col("topic").alias("query")), cut(encode(f)), 3)
    out = signals.why(topics, signals.stances(n), hits)
    return out.select("qid", "topic", "feeling", F.round("intensity", 6).alias("intensity"), F.array_join("evidence", "\n").alias("evidence"))


def q_value_family(spark, sf):
    """Customers' nations dealt over documents of one scope: the scope itself holds nothing, its documents answer."""
    from .catalog import geography

    f = geography(spark, sf).where("idx >= 0")
    child = f.withColumn("scope", F.concat_ws("__", "scope", (F.col("idx") % 7).cast("string")))
    q = table(spark, sf, "customer").select(F.col("c_custkey").alias("qid"), F.lit("geo").alias("scope"), F.concat(F.lit("Cu"), F.col("c_custkey"), F.lit(" nation")).alias("query"))
    return recall.recall_value(q, cut(encode(child))).select("qid", "scope", "value")


def q_fire(spark, sf):
    e = episodes(spark, sf)
    out = recall.fire(last_sentences(e), e)
    return out.select("qid", "idx", F.array_join(F.transform("candidates", lambda x: x.cast("string")), ",").alias("candidates"))


def q_chain_steps(spark, sf):
    """The facts that resolve each customer's way to a nation and a region, and on to a relation that isn't there."""
    from .catalog import geography

    c = table(spark, sf, "customer")
    starts = c.select(F.col("c_custkey").alias("qid"), F.lit("geo").alias("scope"), F.concat(F.lit("Cu"), F.col("c_custkey")).alias("start"), F.array(F.lit("nation"), F.lit("region"), F.lit("planet")).alias("path"))
    out = recall.chain(starts, written(encode(geography(spark, sf).repartition("idx"))), 3)
    return out.select("qid", "value", F.array_join(F.transform("steps", lambda x: x.cast("string")), ",").alias("steps"))


def _stored_index(spark, sf):
    """An index written in two goes: each conversation's first ten facts, then the others."""
    e = episodes(spark, sf)
    path = f"{folder(spark)}/index-{uuid.uuid4().hex}"
    stored.append(e.where("idx < 10"), path)
    stored.append(e.where("idx >= 10"), path)
    return e, stored.load(spark, path)


def q_index_stored(spark, sf):
    return _stored_index(spark, sf)[1].counts.select("scope", "stem", "df")


def q_recall_stored(spark, sf):
    e, index = _stored_index(spark, sf)
    return recall.recall(last_sentences(e), index).select("qid", "fact", "idx", F.round("coverage", 9).alias("coverage"), "overlap", "exact")


def q_model_saved(spark, sf):
    """A trust ledger saved twice, the second time in vain, and read back."""
    path = f"{folder(spark)}/ledger-{uuid.uuid4().hex}"
    ledger = cut(signals.trust(trust_rounds(spark, sf)))
    changed = [models.save_if_changed(ledger, path) for _ in range(2)]
    t = models.load(spark, path)
    return t.select("class", F.round("weight", 6).alias("weight"), "rewards", "penalties", F.lit(changed == [True, False]).alias("once"))


def traits(spark, sf) -> DataFrame:
    """A persona for each user, from the values of their events."""
    e = table(spark, sf, "events").groupBy(F.col("user_id").cast("string").alias("scope")).agg(F.sum(F.floor("value")).cast("long").alias("s"))
    part = lambda k: (F.col("s") / k).cast("long") % 101 / 100
    names = ["openness", "conscientiousness", "extraversion", "agreeableness", "neuroticism"]
    return e.select("scope", *[part(3**i).alias(n) for i, n in enumerate(names)], F.lit(1.5).alias("reactivity"))


def q_persona(spark, sf):
    """Personas stored as variables, read back and described."""
    p = traits(spark, sf)
    rows = signals.persona_rows(p).withColumn("seq", F.lit(0))
    held = store.set_variables(facts(spark, sf).limit(0), rows)
    back = signals.load_personas(store.variables(held))
    return back.select("scope", signals.describe({n: F.col(n) for n in signals.TRAIT_WORDS}).alias("words"), F.round("openness", 4).alias("openness"), "reactivity")


def order_links(spark, sf, ebits: int = 1) -> DataFrame:
    o = table(spark, sf, "orders")
    return o.select(F.col("o_orderkey").alias("id"), F.concat(F.lit("s"), F.col("o_orderkey") % 5).alias("src_scope"), F.concat(F.lit("order "), F.col("o_orderkey")).alias("src_text"), F.concat(F.lit("s"), F.col("o_custkey") % 5).alias("dst_scope"), F.concat(F.lit("customer "), F.col("o_custkey")).alias("dst_text"), F.lit("copy").alias("classical"), F.lit(ebits).alias("ebits"))


def q_disentangle(spark, sf):
    """Links of each scope after every third link is gone."""
    rows = order_links(spark, sf)
    left = links.disentangle(rows, rows.where("id % 3 = 0").select("id"))
    scopes = left.select(F.col("src_scope").alias("scope")).distinct()
    return links.of_scopes(left, scopes).groupBy("scope").agg(F.count(F.lit(1)).alias("links"), F.sum("id").alias("ids"))


def q_entangle(spark, sf):
    rows = order_links(spark, sf)
    new = rows.where("id % 4 = 0").drop("id").withColumn("ebits", F.lit(0))
    return links.entangle(rows.where("id % 4 <> 0"), new).select("id", "src_text", "ebits")


def q_missing_ends(spark, sf):
    rows = order_links(spark, sf)
    held = rows.where("id % 2 = 0").select(F.col("src_scope").alias("scope"), F.col("src_text").alias("t")).distinct()
    return links.missing_ends(rows, held).groupBy("scope").agg(F.count(F.lit(1)).alias("missing"))


def q_cascade(spark, sf):
    """A fact moved along a chain of links for every order: to its customer's scope, and on to the nation's."""
    o = table(spark, sf, "orders").where("o_orderkey % 3 = 0")
    text = F.concat(F.lit("order "), F.col("o_orderkey"), F.lit(" stands"))
    cols = lambda a, b, n: [(F.col("o_orderkey") * 10 + n).alias("id"), F.lit(a).alias("src_scope"), text.alias("src_text"), F.lit(b).alias("dst_scope"), F.concat(F.lit("nothing "), F.col("o_orderkey")).alias("dst_text"), F.lit("copy").alias("classical"), F.lit(1).alias("ebits")]
    made = o.select(*cols("orders", "customers", 1)).unionByName(o.where("o_orderkey % 2 = 0").select(*cols("customers", "nations", 2)))
    asked = o.select(F.col("o_orderkey").alias("qid"), F.lit("orders").alias("scope"), text.alias("fact"), F.col("o_orderkey").cast("string").alias("value"))
    return links.cascade(asked, made).select("qid", "hop", "dst_scope", "dst_fact")


def q_superpose(spark, sf):
    """Each user's event types as alternatives, read three times; what is left, and what has become a fact."""
    e = table(spark, sf, "events").select(F.col("user_id").cast("string").alias("scope"), F.lit("the last event").alias("t"), F.col("event_type").alias("alt"), F.col("event_id").alias("seq"))
    supers = links.superpose(e)
    asked = supers.select(F.explode(F.sequence(F.lit(1), F.lit(5))).alias("seq"), F.col("scope").cast("long").alias("qid"), "scope", "t")
    budgets = supers.select("scope", "t", F.lit(3).alias("reads"))
    answers, rest, left = links.recall_once(asked, budgets, supers)
    n = left.groupBy("scope").agg(F.max(F.size("alts")).alias("left"))
    a = answers.groupBy("scope").agg(F.max("answer").alias("answer"), F.sum(F.col("served").cast("long")).alias("served"))
    b = rest.groupBy("scope").agg(F.max("reads").alias("reads"))
    return a.join(n, "scope", "left").join(b, "scope", "left").select("scope", "answer", "served", F.coalesce("left", F.lit(0)).alias("left"), F.coalesce("reads", F.lit(0)).cast("long").alias("reads"))


def q_survivors(spark, sf):
    e = table(spark, sf, "events").where("event_id % 150 <> 0").groupBy(F.col("user_id").cast("string").alias("scope")).agg(F.array_sort(F.collect_set("event_type")).alias("ts"))
    first = F.when(F.col("scope").cast("long") % 2 == 0, F.slice("ts", 1, 1)).otherwise(F.col("ts"))
    supers = e.select("scope", F.lit("the type").alias("t"), F.transform(first, lambda x: F.struct(x.alias("alt"), F.lit(1.0).alias("w"))).alias("alts"))
    return links.survivors(supers)


def q_place(spark, sf):
    """New scopes on the least loaded of five shards, whose loads differ."""
    o = table(spark, sf, "customer").select(F.format_string("c%09d", "c_custkey").alias("scope"))
    loads = spark.range(5).select(F.col("id").alias("shard"), (F.col("id") * F.col("id")).alias("load"))
    return links.place(o, loads)


def q_capacity(spark, sf):
    """Every message as a turn on scopes that hold at most thirty facts."""
    f = facts(spark, sf)
    wrote = store.observe(messages(spark, sf).withColumn("scope", F.concat_ws("/", "scope", "seq"))).groupBy("scope").agg(F.count(F.lit(1)).alias("wrote"))
    m = messages(spark, sf).select(F.concat_ws("/", "scope", "seq").alias("key"), "scope", F.col("seq").cast("long").alias("qid"))
    turned = m.join(wrote.withColumnRenamed("scope", "key"), "key", "left").select("qid", "scope", F.coalesce("wrote", F.lit(0)).alias("wrote"))
    return turns.capacity(turned, f, 30)


def q_capture(spark, sf):
    """Conversations as text files that arrive in a folder, captured as facts of one scope, each once."""
    base = f"{folder(spark)}/capture-{uuid.uuid4().hex}"
    lines = sentences(spark, sf).select("t").repartition(3)
    lines.write.text(f"{base}/in")
    arriving = capture.keep(capture.line_stream(spark, f"{base}/in"), skip="the")
    capture.capture(arriving, "all", f"{base}/facts", f"{base}/state", window=None).awaitTermination()
    return spark.read.parquet(f"{base}/facts").select("scope", "t")


def q_reinforce_weights(spark, sf):
    """Each user's events as touches on their type's weight, which halves every thousand ticks."""
    e = table(spark, sf, "events").select(F.col("user_id").cast("string").alias("scope"), F.dense_rank().over(Window.partitionBy("user_id").orderBy("event_type")).cast("long").alias("idx"), F.col("event_id").alias("tick"))
    first = e.groupBy("scope", "idx").agg(F.min("tick").alias("tick")).select("scope", "idx", F.lit(1.0).alias("w"), "tick")
    touched = e.where("idx <> 2").select("scope", "idx", "tick", F.lit(0.25).alias("by"))
    raised = adaptive.reinforce(first, touched, 1000.0)
    now = raised.select("scope").distinct().withColumn("now", F.lit(10_000))
    return adaptive.strength(raised, now, 1000.0).select("scope", "idx", F.round("eff", 9).alias("eff"), "facts")


QUERIES = {
    "text_hashes": q_hashes, "text_escapes": q_escapes, "scan_scope": q_scan, "scan_episodes": q_episodes, "scan_updates": q_updates,
    "scan_has_fact": q_has_fact, "log_replay": q_replay, "log_compaction": q_compact, "write_durable": q_durable, "write_load": q_load,
    "write_pack": q_pack_blob, "write_wipe": q_wipe, "write_replace": q_replace, "write_import": q_import, "write_rewrite": q_rewrite,
    "write_reinforce": q_reinforce, "instructions": q_instructions, "instructions_deleted": q_instructions_deleted,
    "variables_list": q_variables_list, "variables_deleted": q_variables_deleted, "recall_scored": q_scored, "write_checked": q_checked,
    "contested_stored": q_stored_marks, "scope_samples": q_samples,
    "recall_keyed": q_keyed, "recall_why": q_why, "recall_value_family": q_value_family, "recall_fire": q_fire, "recall_chain_steps": q_chain_steps,
    "index_stored": q_index_stored, "recall_stored": q_recall_stored, "model_saved": q_model_saved, "persona_described": q_persona,
    "link_disentangle": q_disentangle, "link_entangle": q_entangle, "link_missing_ends": q_missing_ends, "link_cascade": q_cascade,
    "link_superpose": q_superpose, "link_survivors": q_survivors, "link_place": q_place, "turn_capacity": q_capacity, "stream_capture": q_capture,
    "adaptive_strength": q_reinforce_weights,
}
