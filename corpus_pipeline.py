"""A corpus pipeline of five stages, each calling one operator of ``cuewell.llm`` on all rows it gets.

Each stage takes (spark, docs, sf_dir); all but the last return the columns of ``documents``.
Rows keep their ids.  Null texts come out of the text-changing stages as empty ones.  Rows with a null
or repeated id are documents like all others: copies among them go, the rest stays.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuewell.llm import ngram_join, packing, pii, quality_classifier, suffix_dedup
from cuewell.llm.keys import keyed
from cuewell.llm.lineage import cut
from cuewell.llm.textblocks import read_table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Bytes of the shortest repeated passage that goes: under 51 words, which take some 250 bytes or more.
PASSAGE_BYTES = 200


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    model = quality_classifier.fit(docs, read_table(spark, sf_dir, "labels"))
    return quality_classifier.score(docs, model, keep=COLUMNS[1:]).where("predicted = 1").select(COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one of smallest id, of each group of linked documents."""
    rows, _ = keyed(docs)
    gone = ngram_join.join(rows, id_col="key", count=False).where("component_id <> doc_id").select(F.col("doc_id").alias("key"))
    return rows.join(gone, "key", "left_anti").select(COLUMNS)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the strings of PASSAGE_BYTES bytes that also start elsewhere."""
    out = suffix_dedup.dedup(docs, length=PASSAGE_BYTES, keep=["lang", "source"])
    return out.select("doc_id", F.col("kept_text").alias("text"), "lang", "source", F.length("kept_text").cast("long").alias("n_chars"))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data replaced by its kind."""
    found = pii.find(docs, keep=["lang", "source"])
    out = found.withColumn("text", pii.redacted(F.col("clean_text"), F.col("found")))
    return out.withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all texts in sequences of 1024 tokens."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality_classifier", classify),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("suffix_dedup", drop_repeated_passages),
    ("pii", redact),
    ("packing", pack),
]

#: The classifier, the suffix structures and the tokenizer have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, from ``documents``; each result is written to the checkpoint folder."""
    docs = read_table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
