"""Recall semantics on literal facts."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from cuewell.operators import graph, recall, signals, store, turns
from cuewell.operators.encode import encode as encode_facts
from cuewell.plans.lineage import cut


def encode(facts):
    return cut(encode_facts(facts))


def facts_of(spark, texts, scope="a"):
    return spark.createDataFrame([(scope, i, t, 1.0, None) for i, t in enumerate(texts)], "scope string, idx long, t string, strength double, key string")


def ask(spark, queries, scope="a"):
    return spark.createDataFrame([(i, scope, q) for i, q in enumerate(queries)], "qid long, scope string, query string")


def values(df):
    return {r["qid"]: r["value"] for r in df.collect()}


def test_values_and_abstaining(spark):
    ep = encode(facts_of(spark, ["my name is Marisol", "the wifi password is hunter2", "only the first 1,000 users score 150,000 coins", "the plan is pro", "project Graus status is paused", "Aurora is owned by Marisol"]))
    got = values(recall.recall(ask(spark, ["how many users?", "coins?", "what is my name", "wifi password", "blood type?", "subscription tier", "Graus status", "who owns Aurora?"]), ep))
    assert got[0] == "1,000" and got[1] == "150,000" and got[2] == "Marisol" and got[3] == "hunter2"
    assert 4 not in got and got[5] == "pro" and got[6] == "paused" and got[7] == "Marisol"


def test_relations_bind(spark):
    ep = encode(facts_of(spark, ["my dog is named Biscuit", "my sister is named Dana", "project17 runs on the blue cluster", "project170 runs on the green cluster", "the tool is Search Console here"]))
    got = values(recall.recall(ask(spark, ["what is my dog called", "my sister", "project17 cluster"]), ep))
    assert got[0] == "Biscuit" and got[1] == "Dana" and "blue" in got[2]


def test_chain(spark):
    ep = encode(facts_of(spark, ["Aurora owner is Marisol", "Marisol manager is Dana", "Dana timezone is WET", "Borealis owner is Quentin"]))
    starts = spark.createDataFrame([(1, "a", "Aurora", ["owner", "manager", "timezone"]), (2, "a", "Borealis", ["owner", "salary"])], "qid long, scope string, start string, path array<string>")
    got = {r["qid"]: (r["value"], r["trail"]) for r in recall.chain(starts, ep, 3).collect()}
    assert got[1] == ("WET", ["Aurora", "Marisol", "Dana", "WET"])
    assert got[2][0] is None and got[2][1][:2] == ["Borealis", "Quentin"]


def test_spread_reaches_the_end_only_unbounded(spark):
    names = ["alphax", "bravoy", "charlez", "deltaq", "echomm", "foxtrot", "golfer"]
    texts = [f"{a} met {b} once" for a, b in zip(names, names[1:])] + [f"unrelated filler number {i}" for i in range(8)]
    ep = encode(facts_of(spark, texts)).withColumn("strength", F.lit(1.0))
    q = ask(spark, ["alphax"])
    one = {r["idx"] for r in graph.spread(q, ep, 16, 1).collect()}
    end = {r["idx"]: r["act"] for r in graph.spread(q, ep, 16, 0).collect()}
    assert one == {0, 1} and {0, 1, 2, 3, 4, 5} <= set(end)
    assert end[0] > end[1] > end[2] > end[3]


def test_context_and_pages(spark):
    texts = [f"sentence number {i} talks about subject{i} at length" for i in range(12)]
    facts = facts_of(spark, texts)
    got = recall.recall_context(ask(spark, ["subject6"]), encode(facts), facts, 1, 2, 3).collect()
    assert len(got) == 1 and (got[0]["start"], got[0]["hit_pos"], len(got[0]["facts"])) == (4, 2, 6)
    page = store.page(facts, 10, 5).collect()[0]
    assert page["total"] == 12 and page["facts"] == texts[10:]
    assert store.page(facts, 50, 5).collect()[0]["facts"] == []


def test_writes(spark):
    facts = facts_of(spark, ["deploy fails with kernel panic", "the color is blue", "the color of sky is grey"])
    up = store.strengthen(facts, spark.createDataFrame([("a", "KERNEL", 9.0), ("a", "kernel", 4.0)], "scope string, match string, bump double"))
    assert {r["idx"]: r["strength"] for r in up.collect()} == {0: 8.0, 1: 1.0, 2: 1.0}
    new = spark.createDataFrame([("a", 1, "k", "the color is red now"), ("a", 2, "k", "the color is green now"), ("a", 3, "k", "ok")], "scope string, seq long, key string, text string")
    out = store.upsert(facts, new)
    assert [r["t"] for r in out.orderBy("idx").collect()][-1] == "the color is green now" and out.count() == 4
    sets = spark.createDataFrame([("a", 1, "Mood", "calm"), ("a", 2, "mood", "cross")], "scope string, seq long, name string, value string")
    var = store.set_variables(facts, sets)
    got = store.get_variables(var, spark.createDataFrame([("a", "MOOD"), ("a", "none")], "scope string, name string")).collect()
    assert [(r["name"], r["value"]) for r in got] == [("MOOD", "cross")]
    kept, lost = store.drain(facts, 2)
    assert [r["t"] for r in kept.orderBy("idx").collect()] == ["the color is blue", "the color of sky is grey"] and lost.collect()[0]["dropped"] == 1
    odd = facts_of(spark, ["tab\there \\ and\nline", "plain"])
    assert sorted(r["t"] for r in store.load(store.dump(odd)).collect()) == sorted(["tab\there \\ and\nline", "plain"])


@pytest.mark.parametrize(
    ("new", "old", "want"),
    [
        ("the door is not open today", "the door is open today", "negation"),
        ("the sky is blue", "the sky is grey", "value"),
        ("the sky is dark blue", "the sky is dark", None),
        ("cats sleep", "the sky is grey", None),
    ],
)
def test_contradiction(spark, new, old, want):
    df = spark.createDataFrame([(new, old)], "n string, o string")
    close = 0.1 if new == "cats sleep" else 0.9
    assert df.select(signals.contradiction(F.col("n"), F.col("o"), F.lit(close), F.lit(1)).alias("x")).first()["x"] == want


def test_trust_and_stances(spark):
    rounds = spark.createDataFrame([(1, "x", 1.0), (2, "x", -1.0), (3, "x", 0.0), (1, "y", 0.5)], "round long, class string, delta double")
    got = {r["class"]: r for r in signals.trust(rounds).collect()}
    w = 1.0
    for f in (1.25, 0.75, 0.97):
        w = w * f
        w += (1 - w) * 0.01
    assert abs(got["x"]["weight"] - w) < 1e-9 and (got["x"]["rewards"], got["x"]["penalties"]) == (1, 1)
    notes = spark.createDataFrame([("s", i, t, f"f{i}") for i, t in enumerate(["a", "a", "a", "b", "A"])], "scope string, seq long, topic string, feeling string")
    st = {r["topic"].lower(): r for r in signals.stances(notes).collect()}
    assert abs(st["a"]["strength"] - 3.7) < 1e-9 and st["a"]["feeling"] == "f4" and abs(st["b"]["strength"] - 0.9) < 1e-9


def test_turns(spark):
    facts = facts_of(spark, ["my name is Marisol", "the wifi password is hunter2"])
    msgs = ["what is 12 * 11?", "hiii", "what is the wifi password?", "what is my blood type?", "i moved to Lisbon last year", "what is your name?", "7 / 0", "is the wifi password hunter2"]
    df = spark.createDataFrame([(i, "a", m) for i, m in enumerate(msgs)], "qid long, scope string, text string")
    got = {r["qid"]: (r["kind"], r["reply"]) for r in turns.answer(df, encode(facts)).collect()}
    assert got[0] == ("math", "12 * 11 = 132") and got[1][0] == "smalltalk" and got[2] == ("recall", "hunter2")
    assert got[3][0] == "idk" and got[4][0] == "ack" and got[5][0] == "self" and got[7][0] == "recall"


def test_best_of_equals(spark):
    """The finer features decide only among facts of equal exact and overlap; ranking reads no column of the answer."""
    e = encode_facts(spark.createDataFrame([("a", 0, "the old red lamp stands beside the window", 1.0, None), ("a", 1, "the lamp is red", 1.0, None), ("a", 2, "a green lamp is new", 1.0, None)], "scope string, idx long, t string, strength double, key string"))
    q = spark.createDataFrame([(1, "a", "red lamp")], "qid long, scope string, query string")
    assert [(r["idx"], r["overlap"], r["exact"]) for r in recall.recall(q, e).collect()] == [(1, 2, 2)]
    assert "t" not in recall.score(recall.gather(recall.with_cues(q), recall.indexed(e)), recall.with_cues(q), e, [], finer=False).columns


def test_chain_asks_once(spark, monkeypatch):
    """Paths that meet at one place ask its question once."""
    rows = [(f"Cu{i} nation is Na{i % 2}", i) for i in range(40)] + [("Na0 region is Re0", 40), ("Na1 region is Re1", 41)]
    e = encode(spark.createDataFrame([("geo", i, t, 1.0, None) for t, i in rows], "scope string, idx long, t string, strength double, key string"))
    starts = spark.createDataFrame([(i, "geo", f"Cu{i}", ["nation", "region"]) for i in range(40)], "qid long, scope string, start string, path array<string>")
    asked, plain = [], recall.recall
    monkeypatch.setattr(recall, "recall", lambda q, source: asked.append(q.count()) or plain(q, source))
    got = {r["qid"]: (r["value"], r["trail"]) for r in recall.chain(starts, e, 2).collect()}
    assert asked == [40, 2]
    assert got == {i: (f"Re{i % 2}", [f"Cu{i}", f"Na{i % 2}", f"Re{i % 2}"]) for i in range(40)}


def test_chain_steps_break_together(spark):
    """A relation that isn't there breaks every path that comes by, each with its own steps so far."""
    rows = [(f"Cu{i} nation is Na0", i) for i in range(3)] + [("Na0 region is Re0", 40)]
    e = encode_facts(spark.createDataFrame([("geo", i, t, 1.0, None) for t, i in rows], "scope string, idx long, t string, strength double, key string"))
    starts = spark.createDataFrame([(i, "geo", f"Cu{i}", ["nation", "region", "planet"]) for i in range(3)], "qid long, scope string, start string, path array<string>")
    got = {r["qid"]: (r["value"], r["steps"]) for r in recall.chain(starts, e, 3).collect()}
    assert got == {i: (None, [i, 40]) for i in range(3)}


def test_names_of_one_stem_are_not_all_met(spark, monkeypatch):
    """Names of one stem stand in many facts: a chain scores those that hold the name itself, and judges a question once."""
    rows = [(f"Cu{i} nation is Na{i % 2}", i) for i in range(12300, 12800)] + [("Na0 region is Re0", 0), ("Na1 region is Re1", 1)]
    e = encode(spark.createDataFrame([("geo", i, t, 1.0, None) for t, i in rows], "scope string, idx long, t string, strength double, key string"))
    starts = spark.createDataFrame([(i, "geo", f"Cu{i}", ["nation", "region"]) for i in range(12300, 12800)], "qid long, scope string, start string, path array<string>")
    scored, plain = [], recall.score
    monkeypatch.setattr(recall, "score", lambda cand, *a, **k: scored.append(cand.count()) or plain(cand, *a, **k))
    got = {r["qid"]: (r["value"], r["steps"]) for r in recall.chain(starts, e, 2).collect()}
    assert got == {i: (f"Re{i % 2}", [i, i % 2]) for i in range(12300, 12800)}
    assert scored == [500, 4]


def test_best_of_words_is_best_of_all(spark, monkeypatch):
    """What is found among facts that share a whole word equals the best of all that the stems reach."""
    rng = random.Random(5)
    words = ["valley", "valleyed", "bridge", "bridges", "cooper", "coopers", "dog", "cat", "subscription", "plan", "hometown", "name"]
    texts = [" ".join(["harbor", "window", *rng.sample(words, rng.randint(1, 4)), f"zed{1000 + i}"][rng.randint(0, 2) :]) for i in range(140)]
    e = encode(facts_of(spark, texts))
    asked = [" ".join(rng.sample([*words, "harbor", "window", "unheard", f"zed{1000 + i}", f"zed{1000 + i}0"], rng.randint(1, 5))) for i in range(120)]
    asked += ["valleyed harbor window zed10001", "pet named", "zed10001 harbor window"]
    got = {tuple(r) for r in recall.recall(ask(spark, asked), e).collect()}
    nothing = lambda q, index: (recall.gather(q, index).limit(0), q.select("qid", "scope", F.lit(0).alias("most")))
    monkeypatch.setattr(recall, "gather_words", nothing)
    assert got == {tuple(r) for r in recall.recall(ask(spark, asked), e).collect()} and len(got) > 100


def test_spread_across_meets_scopes_as_matrices(spark, monkeypatch):
    """Many scopes are spread in without a row for each query and scope, with the results of one scope at a time."""
    words = ["lamp", "river", "copper", "violin", "harbor", "meadow", "candle"]
    rows = [(f"all__{s}", i, f"the {words[(s + i) % 7]} {words[(s * 3 + i * 2) % 7]} stands near {words[(i * i + s) % 7]}", 1.0, None) for s in range(6) for i in range(5)]
    e = cut(encode_facts(spark.createDataFrame(rows, "scope string, idx long, t string, strength double, key string")))
    q = spark.createDataFrame([(1, "all", "river lamp"), (2, "all", "violin"), (3, "all", "unheard")], "qid long, scope string, query string")
    for hops in (0, 1):
        each = q.select("qid", "query").crossJoin(e.select("scope").distinct()).select("qid", "scope", "query")
        hits = [(r["qid"], not r["seed"], -round(r["act"], 9), r["scope"], r["idx"]) for r in graph.spread(each, e, 4, hops).collect()]
        want = [x for n in (1, 2, 3) for x in sorted(h for h in hits if h[0] == n)[:4]]
        with monkeypatch.context() as m:
            m.setattr(graph, "spread", lambda *a: pytest.fail("a row for each query and scope"))
            got = graph.spread_across(q, e, 4, hops).orderBy("qid", "rank").collect()
        assert [(r["qid"], not r["seed"], -round(r["act"], 9), r["scope"], r["idx"]) for r in got] == want and len(want) == 8


def test_documents_are_written_as_a_table(spark, monkeypatch):
    """recall_across stores its episodes as a compressed table, of which ranking reads its own columns only."""
    from cuewell import catalog

    monkeypatch.setattr(catalog, "cut", lambda df: pytest.fail("whole rows in a checkpoint"))
    assert catalog.q_across(spark, "/root/testdata/sf0.001").columns == ["qid", "rank", "scope", "idx", "overlap", "exact"]


def test_across_stores_no_episodes(spark, monkeypatch):
    """recall_across neither stores nor deals encoded facts, and its hits are those of each scope at a time."""
    from cuewell import catalog
    from cuewell.operators import across

    rng = random.Random(3)
    words = ["valley", "valleyed", "bridge", "bridges", "dog", "pets", "animal", "name", "my", "harbor", "hometown", "teacher", "teaching", "running", "zed1", "the", "many", "3", "wife", "house", "home"]
    rows = [(f"{b}__{i}", j, " ".join(rng.choices(words, k=rng.randint(3, 7))), 1.0) for b in "ab" for i in range(5) for j in range(rng.choice([1, 3, 90]))]
    e = encode(spark.createDataFrame(rows, "scope string, idx long, t string, strength double"))
    q = spark.createDataFrame([(n, rng.choice("ab"), " ".join(rng.choices([*words, "unheard", "teaches", "runs"], k=rng.randint(1, 3)))) for n in range(40)] + [(90, "a", "teaches"), (91, "b", "runs")], "qid long, scope string, query string")
    named = q.withColumnRenamed("scope", "base").join(e.select("scope").distinct(), F.startswith("scope", F.concat("base", F.lit("__")))).select("qid", "scope", "query")
    each = [(r["qid"], -r["exact"], -r["overlap"], -r["coverage"], r["scope"], r["rank"], r["idx"], r["value"], r["echo"]) for r in recall.recall_many(named, e, 4).collect()]
    want = [x[:5] + x[6:] for n in sorted({x[0] for x in each}) for x in sorted(h for h in each if h[0] == n)[:4]]
    with monkeypatch.context() as m:
        m.setattr(recall, "recall_many", lambda *a: pytest.fail("a row for each query and scope"))
        got = recall.recall_across(q, e, 4).orderBy("qid", "rank").collect()
    assert [(r["qid"], -r["exact"], -r["overlap"], -r["coverage"], r["scope"], r["idx"], r["value"], r["echo"]) for r in got] == want and len(want) > 100
    plain = catalog.written
    monkeypatch.setattr(catalog, "written", lambda df: plain(df) if df.columns == ["scope", "query"] else pytest.fail("episodes are stored"))
    assert catalog.q_across(spark, "/root/testdata/sf0.001").count() > 0
    assert [across.is_fact(t) for t in ("the of", "blue lamp", "lamp 3", "key: lamp", "a blue lamp")] == [encode_facts(facts_of(spark, [t])).count() == 1 for t in ("the of", "blue lamp", "lamp 3", "key: lamp", "a blue lamp")]


def test_one_hop_leaves_out_queries_that_a_scope_cannot_serve():
    """One hop in a scope is worked out by a matrix, only for queries whose best so far it may reach."""
    import numpy as np

    rng = random.Random(11)
    words = [f"w{i}" for i in range(40)]
    for n in (1, 3, 30, 300):
        rows = [(i, sorted({*rng.choices(words, k=rng.randint(1, 5)), *(["hub"] if rng.random() < 0.8 else [])}), rng.choice([0.05, 1.0, 3.0])) for i in range(n)]
        cues = [sorted({*rng.choices([*words, "none"], k=rng.randint(1, 3)), *(["hub"] if i % 3 else [])}) for i in range(50)] + [["hub"], ["none"]]
        holders = {}
        for i, c in enumerate(cues):
            for x in c:
                holders.setdefault(x, []).append(i)
        arrays, blocked = {x: np.array(q) for x, q in holders.items()}, frozenset(["w3"])
        by = lambda found: [(int(a), bool(b), round(float(c), 9), int(d), int(e)) for a, b, c, d, e in zip(*found, strict=True)]
        want = by(graph.lit(0, rows, len(cues), holders, 4, 1, blocked))
        assert by(graph.lit_once(0, rows, arrays, np.full(len(cues), -np.inf), 4, blocked)) == want
        best = graph.Best(len(cues), 4)
        for s in range(3):
            best.add(graph.lit_once(best.place(f"s{s}"), rows, arrays, best.least, 4, blocked))
            best.merge()
        assert [x[:3] for x in by(best.parts[0])] == [x[:3] for x in by(graph.merged([graph.lit(s, rows, len(cues), holders, 4, 1, blocked) for s in range(3)], 4))]
        assert not len(graph.lit_once(0, rows, arrays, np.full(len(cues), 1e6), 4, blocked)[0])


def test_orders_are_dealt_and_written_as_a_table(spark, monkeypatch):
    """recall_orders encodes its facts in as many tasks as there are partitions and stores them as a compressed table."""
    from cuewell import catalog

    monkeypatch.setattr(catalog, "cut", lambda df: pytest.fail("whole rows in a checkpoint"))
    dealt, plain = [], catalog.encode
    monkeypatch.setattr(catalog, "encode", lambda df: dealt.append(df._jdf.queryExecution().logical().toString()) or plain(df))
    got = {(r["qid"], r["idx"]) for r in catalog.q_recall_orders(spark, "/root/testdata/sf0.001").collect()}
    assert len(dealt) == 1 and "Repartition" in dealt[0] and got and all(i == 2 * q for q, i in got)
