"""The Arrow pass against the Column functions, on odd tokens."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from cuewell.functions import analysis, hashing
from cuewell.functions import text as T
from cuewell.operators.encode import cues, encode


def odd_texts() -> list[str]:
    rng = random.Random(3)
    alphabet = "abcxyzESY0189 .,!?;:'\"’()[]{}<>-_é ßÄ中١\t  \u0085"
    out = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(200)]
    return [*out, "my name is Marisol", "The Blue Harbor Station's ferry leaves at 9:30", "cities’s buses passes", "who's the boss of Anna Maria Lopez?", "", "   ", "is it on"]


def test_tokens_equal_column_functions(spark):
    texts = odd_texts()
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    c = F.col("t")
    words = df.select("i", T.tokens(c).alias("tok"), T.content(c).alias("q"), T.cue(c).alias("cue"), T.cue(c, False).alias("own"), T.roots(T.content(c)).alias("roots"))
    for r in words.collect():
        t = texts[r["i"]]
        assert analysis.tokens(t) == r["tok"], t
        for expand, name in ((True, "cue"), (False, "own")):
            got = analysis.cue(t, expand)
            assert (got is None) == (not r["q"]), t
            if got:
                assert got[0] == r["q"] and got[1] == r[name], t
        assert analysis.roots_of(r["q"]) == r["roots"], t
    tok = sorted({w for t in texts for w in analysis.tokens(t)})
    table = spark.createDataFrame([(w,) for w in tok], "w string")
    w = F.col("w")
    for r in table.select("w", T.clean_word(w).alias("clean"), T.clip(w).alias("clip"), T.stem(T.clean_word(w)).alias("stem"), T.root(w).alias("root"), T.canon(w).alias("canon"), T.is_number(T.clip(w)).alias("number"), T.is_capital(T.clip(w)).alias("capital")).collect():
        x = analysis.Token(r["w"])
        assert (x.clean, x.clip, x.stem, x.number, x.capital) == (r["clean"], r["clip"], r["stem"], r["number"], r["capital"]), r["w"]
        assert (analysis.root(r["w"]), analysis.canon(r["w"])) == (r["root"], r["canon"]), r["w"]


def test_encode_keeps_columns_and_nulls(spark):
    df = spark.createDataFrame([(1, "the room holds 50 chairs, 8 tables and 200 guests", 7.5), (2, None, 1.0), (3, "", 2.0), (4, "so it is", 3.0)], "idx int, t string, extra double")
    got = encode(df).collect()
    assert [(r["idx"], r["extra"], r["v"]) for r in got] == [(1, 7.5, "200")]
    assert encode(df.limit(0)).collect() == [] and cues(df.select(F.lit(1).alias("qid"), F.lit(None).cast("string").alias("query"))).collect() == []


def test_fnv():
    def plain(b: bytes, h: int) -> int:
        for x in b:
            h = (h ^ x) * hashing.PRIME % (1 << 64)
        return h

    values = [b"", b"a", b"the sky is blue", "größe 中".encode(), bytes(range(256)), b"a"]
    for basis in (hashing.FACT_BASIS, hashing.WORD_BASIS):
        assert hashing.fnv(values, basis).tolist() == [plain(v, basis) for v in values]
    assert hashing.fnv([]).tolist() == []


def test_escapes(spark):
    import json

    texts = ['a "b" \\ c', "tab\tnew\nline\r", "".join(map(chr, range(32))), "plain é 😀", ""]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(T.json_escape(F.col("t")).alias("x")).collect()
    assert [json.loads(f'"{r["x"]}"') for r in got] == texts
    url = spark.createDataFrame([("a+b%20c%C3%A9",), ("%zz",)], "t string").select(T.url_decode(F.col("t")).alias("x")).collect()
    assert [r["x"] for r in url] == ["a b cé", None]
