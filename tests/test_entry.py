"""The driver contract: names agree, and quick queries equal their SQL on the smallest tables."""

from __future__ import annotations

import os

import pytest

SF = "/root/testdata/sf0.001"
QUICK = ["text_sentences", "text_words", "text_content", "text_semantic_tokens", "trust_fold", "trust_rank", "stance_fold", "rank_fusion", "link_partners", "vector_quantize"]


def test_names():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and len(e.queries()) > 50


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", QUICK)
def test_equals_sql(spark, name):
    import duckdb

    import __spark_entry__ as e

    con = duckdb.connect()
    for t in os.listdir(SF):
        con.execute(f"CREATE VIEW {t.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{t}'")
    got = e.queries()[name](spark, SF)
    cols = sorted(got.columns)
    want = con.execute(e.oracle_sql()[name]).df()[cols]
    mine = got.toPandas()[cols]
    key = lambda df: sorted(map(tuple, df.astype(str).replace({"True": "true", "False": "false"}).to_numpy().tolist()))
    assert key(mine) == key(want)
