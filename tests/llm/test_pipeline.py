"""The pipeline's stages on awkward tables, and against plain versions."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from .test_operators import linked_groups, removed, shingle_sets

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def made() -> list[tuple]:
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passage, base = prose(55), prose(120)
    texts = [None, "", " \n ", "one two"] + [prose(rng.randint(20, 200)) for _ in range(20)]
    texts += [f"{prose(60)} {passage} {prose(60)}" for _ in range(6)]
    texts += [base, base, base + " more words", prose(12000), "mail a.b@ex.com " + prose(30), "ab" * 500]
    out = [(i, t, [None, "en"][i % 2], [None, "s1"][i % 2], len(t or "")) for i, t in enumerate(texts)]
    return out + [out[5], out[5], (None, texts[6], "en", "s1", 3), (None, "a null id " + prose(40), None, None, None), (7, prose(50), "en", "s2", 1)]


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame([(i, i % 2, 0) for i in range(30) if i % 3] + [(None, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return d


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(made(), SCHEMA).repartition(3)


def test_every_stage_takes_awkward_rows(spark, sf, docs):
    import corpus_pipeline as p

    # Columns beyond those of documents, with names that stand inside the operators.
    more = docs.withColumns({"key": F.lit(1), "score": F.lit("x"), "spans": F.lit(2), "found": F.lit(3)})
    none = docs.limit(0)
    for name, stage in p.STAGES:
        for given in (docs, more, none):
            out = stage(spark, given, sf)
            if name != "packing":
                assert out.columns == p.COLUMNS
            got = out.collect()
            assert (len(got) > 0) == (given is not none), name


def test_near_duplicates_leave_one(spark, sf, docs):
    import corpus_pipeline as p

    rows = [tuple(r) for r in docs.collect()]
    group = linked_groups(shingle_sets([r[1] for r in rows]))
    got = [tuple(r) for r in p.drop_near_duplicates(spark, docs, sf).collect()]
    assert len(got) == len(set(group))
    known = {}
    for r, g in zip(rows, group, strict=True):
        known.setdefault(g, []).append(r)
    left = list(got)
    for members in known.values():  # of each group its smallest id stays, a null id only where there is no other
        ids = [r[0] for r in members if r[0] is not None]
        best = [r for r in members if r[0] == (min(ids) if ids else None)]
        assert any(r in left for r in best)
        left.remove(next(r for r in best if r in left))
    assert not left


def test_repeated_passages_go(spark, sf, docs):
    import corpus_pipeline as p

    plain = docs.where("doc_id IS NOT NULL AND n_chars <> 1").dropDuplicates()
    rows = plain.collect()
    want = dict(zip([r["doc_id"] for r in rows], removed([(r["text"] or "").encode() for r in rows], p.PASSAGE_BYTES), strict=True))
    got = {r["doc_id"]: len(r["text"].encode()) for r in p.drop_repeated_passages(spark, plain, sf).collect()}
    assert got == {r["doc_id"]: len((r["text"] or "").encode()) - want[r["doc_id"]] for r in rows}
    assert all(want[i] for i in range(24, 30))  # the passage of 55 words


def test_redaction_and_packing(spark, sf, docs):
    import corpus_pipeline as p

    out = {r["doc_id"]: r["text"] for r in p.redact(spark, docs.where("doc_id >= 20"), sf).collect()}
    assert out[34].startswith("mail [email] ")
    pieces = p.pack(spark, docs, sf)
    whole = pieces.groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("t")).where("doc_id BETWEEN 10 AND 30")
    assert whole.where("n <> t").isEmpty() and whole.count() == 21


def test_run(spark, tmp_path):
    import corpus_pipeline as p

    d = str(tmp_path)
    spark.createDataFrame(made(), SCHEMA).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(30)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    assert p.run(spark, d).count() > 0
