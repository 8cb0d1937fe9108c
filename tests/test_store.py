"""Writes, logs, indexes, models, links and meaning on small tables."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from cuewell.operators import adaptive, index, links, models, recall, semantic, signals, store, topics, vectors
from cuewell.operators.encode import encode
from cuewell.plans.lineage import cut
from cuewell.plans.numbering import numbered
from cuewell.streaming import capture

FACT = "scope string, idx long, t string, strength double, key string"


def made(spark, *rows):
    return spark.createDataFrame([(s, i, t, 1.0, None) for s, i, t in rows], FACT)


def texts(df, scope="a"):
    return [r["t"] for r in df.where(F.col("scope") == scope).orderBy("idx").collect()]


def test_writes(spark):
    f = made(spark, ("a", 0, "the sky is blue"), ("a", 1, "the sea is green"), ("a", 2, "the sky is blue"), ("a::var", 0, "pin is 1234"), ("b", 0, "the sky is grey"))
    new = spark.createDataFrame([("a", 5, "the sky is blue"), ("a", 6, "grass is tall. trees are old."), ("a", 7, "trees are old."), ("a", 8, "what is it?")], "scope string, seq long, text string")
    assert texts(store.observe_durable(new, f)) == ["the sky is blue", "the sea is green", "the sky is blue", "grass is tall.", "trees are old."]
    changed = store.rewrite(f, spark.createDataFrame([("a", "the sky is blue", "the sky is red"), ("a", "nope", "no such fact is here"), ("b", "the sky is grey", "it")], "scope string, old string, new string"))
    assert texts(changed) == ["the sea is green", "the sky is blue", "the sky is red"] and texts(changed, "b") == ["the sky is grey"]
    assert sorted(r["scope"] for r in store.wipe(f, spark.createDataFrame([("a",)], "scope string")).collect()) == ["b"]
    got = store.strengthen(f, spark.createDataFrame([("a", "SKY", 9.0), ("a", "the", 0.001), ("b", "sea", 1.0)], "scope string, match string, bump double"))
    assert sorted((r["scope"], r["idx"], round(r["strength"], 3)) for r in got.collect()) == [("a", 0, 5.05), ("a", 1, 1.05), ("a", 2, 5.05), ("a::var", 0, 1.0), ("b", 0, 1.0)]
    named = store.get_variables(made(spark, ("v", 0, "my car is what is fast"), ("v", 1, "pin is 1")), spark.createDataFrame([("v", "my car is what"), ("v", "MY CAR"), ("v", "car")], "scope string, name string"))
    assert sorted((r["name"], r["value"]) for r in named.collect()) == [("MY CAR", "what is fast"), ("my car is what", "what is fast")]
    assert [r["blob"] for r in store.unpack(store.pack(store.dump(f.where("scope = 'b'")))).collect()] == ["0\tthe sky is grey\t1.0"]
    none = f.limit(0)
    assert store.replay(none, none.withColumn("seq", F.lit(0))).collect() == [] and store.rewrite(none, spark.createDataFrame([("a", "x", "the y is z")], "scope string, old string, new string")).collect() == []


def test_compaction(spark):
    log = spark.range(300).select(F.lit("a").alias("scope"), F.col("id").alias("seq"), F.concat(F.lit("fact "), "id").alias("t"), F.lit(1.0).alias("strength"), F.lit(None).cast("string").alias("key"))
    snapshot = made(spark, ("a", 0, "first"), ("b", 0, "other"))
    whole, rest = store.compact(snapshot, log)
    assert whole.count() == 302 and rest.count() == 0
    whole, rest = store.compact(snapshot, log, 301)
    assert whole.count() == 2 and rest.count() == 300


def test_stored_index(spark, tmp_path):
    rows = [("a" if i % 2 else "b", i // 2, f"the item number {i} is colour{i % 5} today") for i in range(60)]
    e = cut(encode(made(spark, *rows)))
    path = str(tmp_path / "index")
    for part in (e.where("idx < 11"), e.where("idx >= 11")):
        index.append(part, path)
    held = index.load(spark, path)
    q = spark.createDataFrame([(1, "a", "which colour is item number 7"), (2, "b", "item 30"), (3, "b", "nothing of the kind")], "qid long, scope string, query string")
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(recall.recall(q, held)) == key(recall.recall(q, e)) and key(recall.recall_many(q, held, 4)) == key(recall.recall_many(q, e, 4))
    one = index.load(spark, path, ["a"])
    assert {r["scope"] for r in one.postings.select("scope").distinct().collect()} == {"a"}
    assert key(recall.recall(q.where("scope = 'a'"), one)) == key(recall.recall(q.where("scope = 'a'"), e))


def test_models(spark, tmp_path):
    path = str(tmp_path / "m")
    assert models.load(spark, path) is None
    a = spark.createDataFrame([("x", 1.0), ("y", 2.0)], "class string, weight double")
    assert models.save_if_changed(a, path) and not models.save_if_changed(a.repartition(2), path)
    assert models.save_if_changed(a.where("class = 'x'"), path) and models.load(spark, path).count() == 1
    rng = np.random.default_rng(1)
    rows = spark.createDataFrame([([float(v) for v in rng.normal(i % 2, 1, 4)], "+" if i % 2 else "-") for i in range(40)], "vec array<double>, class string")
    from cuewell.operators import discriminant

    found, second = discriminant.class_moments(rows)
    kept, again = models.moments_of(models.moments_table(spark, found, second))
    w, c = discriminant.axis(found, second, "+", "-")
    w2, c2 = discriminant.axis(kept, again, "+", "-")
    assert np.allclose(w, w2) and c == c2 and [n for n, _ in models.classes(kept)] == ["+", "-"]


def test_numbers(spark):
    df = spark.range(1000).select(((F.col("id") * 7919) % 1000).alias("x"))
    assert [r["n"] for r in numbered(df, ["x"]).orderBy("x").collect()] == list(range(1, 1001))
    assert numbered(df.limit(0), ["x"]).collect() == []
    scopes = spark.range(7).select(F.format_string("s%d", "id").alias("scope"))
    loads = spark.createDataFrame([(0, 2), (1, 0)], "shard long, load long")
    got = [r["shard"] for r in links.place(scopes, loads).orderBy("scope").collect()]
    assert got == [1, 1, 0, 1, 0, 1, 0]
    got = [r["shard"] for r in links.place(scopes, loads, 3).orderBy("scope").collect()]
    assert got == [1, 1, 0, 1, 2, 2, 2]
    assert [r["shard"] for r in links.place(scopes, loads.limit(0), 4).orderBy("scope").collect()] == [0, 0, 0, 0, 1, 1, 1]


def test_meaning(spark):
    corpus = ["the router connects laptops with wireless internet signals", "wireless internet signals reach laptops through the router", "the chef cooks onion soup with butter", "butter and onion give soup its taste for the chef"] * 8
    train = cut(vectors.train(spark.createDataFrame([(t,) for t in corpus], "text string")))
    f = made(spark, ("a", 0, "the router stands upstairs"), ("a", 1, "onion soup simmers slowly"), ("a", 2, "butter melts quickly"))
    q = spark.createDataFrame([(1, "a", "wireless laptops"), (2, "a", "unheard words only"), (3, "a", "chef soup")], "qid long, scope string, query string")
    ef, eq = (cut(semantic.embedded(*x)) for x in ((f, train, ["scope", "idx"], "t"), (q, train, ["qid", "scope"], "query")))
    got = {r["qid"]: r["idx"] for r in semantic.recall_semantic(eq, ef).collect()}
    assert got.get(1) == 0 and 2 not in got
    assert semantic.recall_semantic(eq, ef, near=1.1).collect() == []
    blended = semantic.recall_blended(q, f, eq, ef, 2).where("qid = 3 AND rank = 1").first()
    assert blended["idx"] == 1
    durable = {r["qid"]: (r["idx"], r["overlap"]) for r in semantic.recall_durable(q, encode(f), eq, ef).collect()}
    assert durable[1] == (0, 0) and durable[3][1] > 0
    words = cut(vectors.dense(train, ["word"]).withColumnRenamed("word", "id"))
    near = vectors.nearest(words, words.where("id = 'soup'").withColumnRenamed("id", "qid"), 3)
    assert {r["id"] for r in near.collect()} <= {"onion", "butter", "chef", "cooks", "taste", "give"}
    gate = spark.createDataFrame([(1, "a", 1)], "qid long, scope string, idx long")
    assert [(r["qid"], r["idx"]) for r in semantic.similar(eq.where("qid = 1"), ef, gate).collect()] == [(1, 1)]
    m = spark.createDataFrame([(i, t) for i, t in enumerate(corpus)], "id long, text string")
    a = cut(topics.token_topics(m, 2, 6))
    mixed = topics.fold_in(spark.createDataFrame([(1, "chef soup"), (2, "no known word")], "id long, text string"), a, 2).collect()
    assert {r["id"] for r in mixed} <= {1}


def test_marks_and_why(spark):
    hits = spark.createDataFrame([(1, "a", 1, "the door is open", 1.0, 3, 2)], "qid long, scope string, rank int, fact string, coverage double, overlap int, exact int")
    said = spark.createDataFrame([(1, "the door is not open")], "qid long, query string")
    marks = signals.observe_checked(said, hits)
    got = signals.scored(hits, marks).first()
    assert got["contested"] and got["with"] == "the door is not open"
    f = spark.createDataFrame([("a", 0, "Cats: fine", 1.0, None), ("a", 1, "dogs: loud", 2.0, None)], FACT)
    noted = signals.reinforce(f, spark.createDataFrame([("a", "cats", "lovely"), ("a", "fish", "calm")], "scope string, topic string, feeling string"))
    assert texts(noted) == ["dogs: loud", "cats: lovely", "fish: calm"] and noted.where("t LIKE 'cats%'").first()["strength"] == 2.0
    views = spark.createDataFrame([("a", "cats", "lovely", 2.0)], "scope string, topic string, feeling string, strength double")
    ask = spark.createDataFrame([(1, "a", "cats"), (2, "a", "birds")], "qid long, scope string, topic string")
    assert [(r["qid"], r["evidence"]) for r in signals.why(ask, views, hits).collect()] == [(1, ["the door is open"])]


def test_folds_compose(spark, monkeypatch):
    """Chunks of a few statements give what one chunk of all gives."""
    notes = spark.createDataFrame([("a", i, "xyxxzyyyx"[i % 9], f"f{i}") for i in range(60)], "scope string, seq long, topic string, feeling string")
    rounds = spark.createDataFrame([(i, "c", ((i * 37) % 11 - 5) / 5) for i in range(50)], "round long, class string, delta double")
    key = lambda df: sorted((r[0], r[1], *[round(x, 9) if isinstance(x, float) else x for x in r[2:]]) for r in df.collect())
    whole = key(signals.stances(notes)), key(signals.trust(rounds).select("class", "rewards", "penalties", "weight"))
    monkeypatch.setattr(signals, "CHUNK", 4)
    assert (key(signals.stances(notes)), key(signals.trust(rounds).select("class", "rewards", "penalties", "weight"))) == whole


def test_adaptive_weights(spark):
    w = spark.createDataFrame([("a", 0, 1.0, 0), ("a", 1, 1.0, 0)], "scope string, idx long, w double, tick long")
    up = adaptive.reinforce(w, spark.createDataFrame([("a", 0, 8, 1.0), ("a", 2, 8, 1.0)], "scope string, idx long, tick long, by double"), 8.0)
    assert sorted((r["idx"], r["w"], r["tick"]) for r in up.collect()) == [(0, 1.5, 8), (1, 1.0, 0), (2, 2.0, 8)]
    eff = adaptive.strength(up, spark.createDataFrame([("a", 16)], "scope string, now long"), 8.0)
    assert sorted((r["idx"], r["eff"], r["facts"]) for r in eff.collect()) == [(0, 0.75, 3), (1, 0.25, 3), (2, 1.0, 3)]


def test_capture_learns_and_forgets(spark, tmp_path):
    source, table, models_, tee = (str(tmp_path / x) for x in ("in", "facts", "models", "tee"))
    (tmp_path / "in").mkdir()
    for n, lines in enumerate((["the sky is blue", "the sea is green"], ["the sky is blue", "the sun is hot", "skip the moon is cold"], ["the sea is green"])):
        (tmp_path / "in" / f"{n}.txt").write_text("\n".join(lines) + "\n")
        stream = capture.keep(capture.line_stream(spark, source), skip="skip")
        capture.capture(stream, "s", table, str(tmp_path / "state"), window=2, models=models_, tee=tee).awaitTermination()
    got = [(r["batch"], r["t"]) for r in spark.read.parquet(table).orderBy("batch", "line").collect()]
    # A window of two facts: the sea is out of it when the third file comes.
    assert got == [(0, "the sky is blue"), (0, "the sea is green"), (1, "the sun is hot"), (2, "the sea is green")] or got == [(0, "the sky is blue"), (0, "the sea is green"), (1, "the sun is hot")]
    whole = vectors.train(spark.createDataFrame([(t,) for _, t in got], "text string"))
    key = lambda df: sorted(map(tuple, df.select("word", "dim", "val").collect()))
    assert key(capture.learned(spark, models_)) == key(whole) and spark.read.parquet(tee).count() == 5


def test_meaning_leaves_the_driver_alone(spark, monkeypatch):
    """No word vector comes to the driver, and cosines of texts are those of embedded texts."""
    corpus = ["the router connects laptops with wireless internet signals", "the chef cooks onion soup with butter"] * 3
    texts = spark.createDataFrame([(t,) for t in corpus], "text string")
    sparse, packed = cut(vectors.train(texts)), cut(vectors.train_packed(texts))
    f = made(spark, *(("a", i, t) for i, t in enumerate(["the router stands upstairs", "onion soup simmers", "nothing known", "butter and laptops"])), ("b", 0, "wireless signals"))
    q = spark.createDataFrame([(1, "a", "wireless laptops"), (2, "a", "unheard words only"), (3, "a", "chef soup"), (4, "b", "internet")], "qid long, scope string, query string")
    with monkeypatch.context() as m:
        m.setattr(type(f), "collect", lambda self: pytest.fail("rows came to the driver"))
        pairs = [[semantic.embedded(f, v, ["scope", "idx"], "t"), semantic.embedded(q, v, ["qid", "scope"], "query")] for v in (sparse, packed)]
        every = semantic.cosines(q, f, packed, ([0.1] * vectors.DIM, 0.01))
    got = {(r["qid"], r["idx"]): r["cosine"] for r in every.collect()}
    assert {k[0] for k in got if k[1] is None} == {1, 3, 4}
    for ef, eq in pairs:
        want = {(r["qid"], r["idx"]): r["cosine"] for r in semantic.similar(eq, ef).collect()}
        assert {k for k in got if k[1] is not None} == set(want) and len(want) == 7
        assert all(abs(got[k] - want[k]) < 1e-12 for k in want)
