"""Links, adaptive tier, secure values, packs, streams, vectors, topics and the op vocabulary."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from cuewell.operators import adaptive, discriminant, links, secure, topics, vectors
from cuewell.operators.encode import encode
from cuewell.plans.lineage import cut
from cuewell.plans.ops import Memory, clamp
from cuewell.sources import packs
from cuewell.streaming import capture

LINK = "id long, src_scope string, src_text string, dst_scope string, dst_text string, classical string, ebits int"


def test_links(spark):
    table = spark.createDataFrame([(1, "a", "the code is falcon", "b", "the copy is none", "invert", 2), (2, "b", "the inverted", "c", "x", "copy", 1)], LINK)
    req = spark.createDataFrame([(1, "a", "the code is falcon", "falcon"), (2, "a", "the code is falcon", "falcon"), (3, "a", "the code is falcon", "falcon")], "qid long, scope string, fact string, value string")
    moves = links.teleport(req, table).orderBy("qid").collect()
    assert [(m["qid"], m["ebits_left"], m["dst_fact"], m["value"]) for m in moves] == [(1, 1, "the code is noclaf", "noclaf"), (2, 0, "the code is noclaf", "noclaf")]
    left = links.after_moves(table, links.teleport(req, table)).collect()
    assert [r["id"] for r in left] == [2]
    ends = links.find(table, spark.createDataFrame([("b", "the copy is none")], "scope string, t string")).collect()
    assert [(r["id"], r["partner"]) for r in ends] == [(1, "the code is falcon")]
    got = spark.createDataFrame([("4491",), ("-3.5",), ("falcon",), ("2.0",)], "v string").select(links.invert(F.col("v")).alias("x")).collect()
    assert [r["x"] for r in got] == ["-4491", "3.5", "noclaf", "-2"]
    new = links.entangle(table, spark.createDataFrame([("z", "p", "y", "q", "copy", 0)], "src_scope string, src_text string, dst_scope string, dst_text string, classical string, ebits int"))
    assert new.where("id = 3").first()["ebits"] == 1


def test_cascade_and_reads(spark):
    table = spark.createDataFrame([(1, "a", "alpha", "b", "beta", "copy", 1), (2, "b", "alpha", "c", "gamma", "copy", 1)], LINK)
    req = spark.createDataFrame([(1, "a", "alpha", "alpha")], "qid long, scope string, fact string, value string")
    out = links.cascade(req, table, 5).orderBy("hop").collect()
    assert [(r["hop"], r["dst_scope"], r["dst_fact"]) for r in out] == [(1, "b", "alpha"), (2, "c", "alpha")]
    budgets = spark.createDataFrame([("a", "t", 2)], "scope string, t string, reads int")
    served, rest = links.spend_reads(budgets, spark.createDataFrame([("a", "t", i) for i in range(3)] + [("a", "u", 9)], "scope string, t string, seq long"))
    assert sorted((r["t"], r["seq"], r["served"]) for r in served.collect()) == [("t", 0, True), ("t", 1, True), ("t", 2, False), ("u", 9, True)]
    assert rest.collect() == []
    alts = spark.createDataFrame([([("x", 1.0), ("y", 1.0)],)], "a array<struct<alt:string,w:double>>")
    m = alts.select(links.measure(F.col("a"), F.lit(4)).alias("m")).first()["m"]
    assert m["chosen"] == "x" and [r["alt"] for r in m["rest"]] == ["x"] and abs(m["rest"][0]["w"] - 1.1**4) < 1e-9


def test_secure(spark):
    rows = spark.createDataFrame([("s", 1, "the bank pin", "1234"), ("s", 2, "the bank pin", "5678"), ("s", 3, "it is", "lost")], "scope string, seq long, phrase string, value string")
    store = cut(secure.put(rows, b"key"))
    assert store.count() == 2 and not any(b in r["ct"] for r in store.collect() for b in ("1234", "5678"))
    q = spark.createDataFrame([(1, "s", "what is my bank pin"), (2, "s", "shoe size")], "qid long, scope string, query string")
    assert [(r["qid"], r["value"]) for r in secure.get(q, store, b"key").collect()] == [(1, "5678")]
    assert secure.get(q, store, b"other").collect() == []


def test_packs(spark, tmp_path):
    (tmp_path / "a.facts").write_text('# scope: one\nthe sky is blue\n# note\nthe sky is blue\n{"scope": "two", "fact": "the sea is green"}\nbad\tline\n# scope: three\nlast fact here\n')
    got = sorted((r["scope"], r["t"]) for r in packs.import_pack(packs.read_lines(spark, str(tmp_path))).collect())
    assert got == [("one", "the sky is blue"), ("three", "last fact here"), ("two", "the sea is green")]
    facts = spark.createDataFrame([("one", 1, "b"), ("one", 0, "a"), ("odd name", 0, "c")], "scope string, idx long, t string")
    out = {r["scope"]: r["text"] for r in packs.export_pack(facts).collect()}
    assert out["one"] == "# scope: one\na\nb" and '"fact":"c"' in out["odd name"]


def test_capture_equals_batch(spark, tmp_path):
    src, table, ck = tmp_path / "in", tmp_path / "out", tmp_path / "ck"
    src.mkdir()
    (src / "1.txt").write_text("the build failed on node7\r\nskip this DEBUG line\n\n")
    (src / "2.txt").write_text("the build failed on node7\nthe disk of node9 is full\n")
    lines = capture.keep(capture.line_stream(spark, str(src)), skip="DEBUG")
    capture.capture(lines, "ops", str(table), str(ck)).awaitTermination(120)
    got = sorted(r["t"] for r in spark.read.parquet(str(table)).collect())
    assert got == ["the build failed on node7", "the disk of node9 is full"]
    long = spark.createDataFrame([("x" * 10 + "\nab",)], "v string").select(capture.split_lines(F.col("v"), 4).alias("l")).first()["l"]
    assert long == ["xxxx", "xxxx", "xx", "ab"]


def test_adaptive(spark):
    facts = spark.createDataFrame([("s", 0, "the phoenix rollout is monday"), ("s", 1, "the phoenix budget is friday"), ("s", 2, "the phoenix budget is friday")], "scope string, idx long, t string")
    ep = cut(encode(facts))
    q = spark.createDataFrame([(1, "s", 1, "phoenix rollout"), (2, "s", 2, "phoenix"), (3, "s", 3, "phoenix")], "qid long, scope string, seq long, query string")
    got = {r["qid"]: (r["idx"], r["weight"]) for r in adaptive.recall_session(q, ep).collect()}
    assert got[1] == (0, 1.0) and got[2] == (0, 2.0) and got[3] == (0, 3.0)
    w = ep.select("scope", "idx", F.lit(0.3).alias("eff"))
    kept = adaptive.consolidate(ep, w, 0.4).collect()
    assert [(r["idx"], r["merged"], round(r["eff"], 6)) for r in kept] == [(1, 2, 0.6)]
    pairs = spark.createDataFrame([("s", 0, 1, 2.0), ("s", 1, 2, 1.0)], "scope string, a long, b long, w double")
    seeds = spark.createDataFrame([(1, "s", 0, 1.0)], "qid long, scope string, idx long, act double")
    one = spark.createDataFrame([("s", i, 1.0) for i in range(3)], "scope string, idx long, eff double")
    act = {r["idx"]: r["act"] for r in adaptive.spread_links(seeds, pairs, one, 2, 5).collect()}
    assert act[0] == pytest.approx(1 + 0.7 * 0.7 * 2 / 3, abs=1e-4) and act[1] == 0.7 and act[2] == pytest.approx(0.7 * 0.7 / 3, abs=1e-4)
    moved = adaptive.rewire(pairs, adaptive.consolidate(ep, w.withColumn("eff", F.lit(1.0)), 0.4), ep).collect()
    assert [(r["a"], r["b"], r["w"]) for r in moved] == [(0, 1, 2.0)]


def test_vectors(spark):
    texts = spark.createDataFrame([(i, t) for i, t in enumerate(["router connects network cable", "network router uses cable", "soup needs salt pepper", "salt pepper season soup"] * 4)], "id long, text string")
    v = cut(vectors.train(texts))
    want: dict[str, np.ndarray] = {}
    for r in texts.collect():
        toks = r["text"].split()
        for i, t in enumerate(toks):
            for j in range(max(0, i - 5), min(len(toks), i + 6)):
                if j != i:
                    for e in vectors.index_entries([toks[j]])[0]:
                        want.setdefault(t, np.zeros(vectors.DIM))[abs(e) - 1] += np.sign(e)
    got: dict[str, np.ndarray] = {}
    for r in v.collect():
        got.setdefault(r["word"], np.zeros(vectors.DIM))[r["dim"]] = r["val"]
    assert set(got) == set(want) and all((got[w] == want[w]).all() for w in want)
    e = cut(vectors.embed(texts.limit(4), v))
    pairs = spark.createDataFrame([(0, 1), (0, 2)], "a_id long, b_id long")
    cos = {(r["a_id"], r["b_id"]): r["cosine"] for r in vectors.pair_similarity(e, e, pairs).collect()}
    assert cos[0, 1] > 0.5 and cos.get((0, 2), 0.0) < 0.5
    rng = np.random.default_rng(1)
    rows = [(i, (rng.normal(0, 0.1, 4) + (3 if i % 2 else -3) * np.eye(4)[0]).tolist(), "+" if i % 2 else "-") for i in range(40)]
    df = spark.createDataFrame(rows, "id long, vec array<double>, class string")
    groups = {r["id"]: r["cluster"] for r in vectors.kmeans(df, 2, 4).collect()}
    assert len({groups[i] for i in range(0, 40, 2)}) == 1 and groups[0] != groups[1]
    found = discriminant.axis(*discriminant.class_moments(df), "+", "-")
    z = {r["id"]: r["z"] for r in df.select("id", discriminant.axis_score(F.col("vec"), *found).alias("z")).collect()}
    assert all((z[i] > 0) == bool(i % 2) for i in z)
    coords, var, total = vectors.project(df, 2)
    assert var[0] > 0.9 * total and coords.count() == 40


def test_topics(spark):
    net, cook = "router network cable packet switch".split(), "soup salt pepper onion butter".split()
    rng = np.random.default_rng(3)
    rows = [(i, "n" if i % 2 else "c", i, " ".join(rng.choice(net if i % 2 else cook, 4))) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, scope string, idx long, text string")
    a = topics.token_topics(df, 4, 12)
    assert {r["word"] for r in a.select("word").distinct().collect()} == set(net + cook)
    per = {(r["id"], r["topic"]) for r in topics.mixture(a, 4).where("rank = 1").collect()}
    assert not {t for i, t in per if i % 2} & {t for i, t in per if i % 2 == 0}
    q = spark.createDataFrame([(1, "n", "packet network")], "qid long, scope string, query string")
    assert topics.topic_gate(q, a, df).count() == 30 and topics.top_words(a, 2).count() >= 2


def test_memory_ops(spark):
    none = spark.createDataFrame([], "scope string, idx long, t string, strength double, key string")
    msgs = spark.createDataFrame([("u", 1, "My plan is pro. Does it work? The manager is Dana Reyes."), ("u", 2, "ok")], "scope string, seq long, text string")
    m = Memory(none).apply("observe", msgs)
    assert [r["t"] for r in m.facts.orderBy("idx").collect()] == ["My plan is pro.", "The manager is Dana Reyes."]
    q = spark.createDataFrame([(1, "u", "who is my boss")], "qid long, scope string, query string")
    assert m.apply("recall_one", q).first()["value"] == "Dana Reyes"
    assert clamp("recall_k", 999) == 50 and clamp("page", 0) == 1
    assert m.apply("forget").facts.count() == 0 and m.apply("stats").first()["facts"] == 2
    more = m.apply("observe", spark.createDataFrame([("u", 1, "My plan is pro.")], "scope string, seq long, text string"))
    assert more.facts.count() == 2


def test_places_of_many_rows(spark):
    """Seeds of k-means where ranges are cut by a sample: the rows at given places, not at near ones."""
    unit = spark.range(60_000, numPartitions=4).select((F.col("id") * 7919 % 60_000).alias("id")).select("id", F.array(F.col("id").cast("double")).alias("u"))
    places = [0, 7_500, 15_000, 30_001, 59_999]
    assert vectors._rows_at(unit, places) == [[float(x)] for x in places]
