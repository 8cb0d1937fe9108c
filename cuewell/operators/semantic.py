"""Recall by meaning: paraphrases that share no stem with their fact, and fusion with the lexical order.

Facts and queries come embedded as (scope, idx, vec) and (qid, scope, vec) with unit vectors.  A query
meets the candidates of its own scope only: those that a topic gate gives, else the scope's last
WINDOW facts.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType
from pyspark.sql.window import Window

from ..functions import text as T
from ..functions.hashing import sampled
from ..plans.lineage import cut, written
from . import recall as lexical
from .store import family
from .vectors import DIM, dot, packed, unpack_sums

WINDOW, FUSION = 4000, 60
NEAR, CLEAR, FIELD = 0.20, 0.10, 3


#: Texts that share a table of their words' vectors in a task, and texts worked on at a time.
GROUP_TEXTS, BLOCK = 8192, 1000


def _beside_words(texts: DataFrame, vectors: DataFrame, groups: int, by: list[str], order: list) -> DataFrame:
    """Texts (own columns, _ts) dealt into groups by some columns, the packed vectors of each group's words
    before them (word is null in texts); a word is sent to a group once, however often it stands there."""
    own = texts.withColumn("_g", F.pmod(F.xxhash64(*by), F.lit(groups)).cast("int"))
    needed = own.select("_g", F.explode("_ts").alias("word")).distinct().join(packed(vectors), "word")
    both = own.unionByName(needed, allowMissingColumns=True)
    return both.repartition(groups, "_g").sortWithinPartitions("_g", F.col("word").isNull(), *order)


def _groups(spark, n: int) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // GROUP_TEXTS))


class _Words:
    """The unit vectors of a group's words, and of texts by them."""

    def __init__(self, dim: int):
        self.dim, self.group, self.at, self.rows, self.unit = dim, None, {}, [], None

    def add(self, group: int, batch: pa.RecordBatch) -> None:
        """Takes rows (word, d, x) of one group."""
        if group != self.group:
            self.group, self.at, self.rows, self.unit = group, {}, [], None
        self.at.update({w: len(self.at) + i for i, w in enumerate(batch.column("word").to_pylist())})
        self.rows += zip(batch.column("d").to_pylist(), batch.column("x").to_pylist(), strict=True)

    def embed(self, group: int, tokens: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Which texts have a vector, and the unit vectors of these."""
        if group != self.group:
            self.group, self.at, self.rows, self.unit = group, {}, [], None
        if self.unit is None:
            self.unit = np.zeros((len(self.at), self.dim))
            for lo in range(0, len(self.rows), BLOCK):
                row, place, val = unpack_sums(*zip(*self.rows[lo : lo + BLOCK], strict=True))
                self.unit[lo + row, place] = val
            self.unit /= np.maximum(np.linalg.norm(self.unit, axis=1), 1e-300)[:, None]
            self.rows = []
        sums = np.zeros((len(tokens), self.dim))
        for i, ts in enumerate(tokens.to_pylist()):
            own = [self.at[t] for t in ts if t in self.at]
            if own:
                sums[i] = self.unit[own].sum(0)
        norm = np.linalg.norm(sums, axis=1)
        return norm > 0, sums[norm > 0] / norm[norm > 0][:, None]


def _runs(batches):
    """(group, whether texts, batch) of rows in order, split where group or kind change."""
    for b in batches:
        if not b.num_rows:
            continue
        g, text = b.column("_g").to_numpy(), pc.is_null(b.column("word")).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero((np.diff(g) != 0) | (np.diff(text.astype(np.int8)) != 0)) + 1).tolist(), b.num_rows]
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            for i in range(lo, hi, BLOCK):
                yield int(g[i]), bool(text[i]), b.slice(i, min(BLOCK, hi - i))


def embedded(texts: DataFrame, vectors: DataFrame, keys: list[str], text_col: str, dim: int = DIM) -> DataFrame:
    """(keys, vec): the unit vectors of texts; texts without a known word are absent.

    vectors: (word, dim, val) or packed.  Texts are dealt into groups and meet the vectors of their
    group's words there; nothing comes to the driver but a count.
    """
    tok = texts.select(*keys, T.semantic_tokens(F.col(text_col)).alias("_ts")).where(F.size("_ts") > 0)
    schema = StructType([*tok.schema.fields[:-1], StructField("vec", ArrayType(DoubleType()))])

    def run(batches):
        words = _Words(dim)
        for group, text, b in _runs(batches):
            if not text:
                words.add(group, b)
                continue
            kept, vec = words.embed(group, b.column("_ts"))
            offs = pa.array(np.arange(len(vec) + 1, dtype=np.int32) * dim)
            same = b.filter(pa.array(kept))
            yield pa.RecordBatch.from_arrays([*(same.column(k) for k in keys), pa.ListArray.from_arrays(offs, pa.array(vec.ravel()))], names=[*keys, "vec"])

    return _beside_words(tok, vectors, _groups(texts.sparkSession, tok.count()), keys, []).mapInArrow(run, schema)


def cosines(queries: DataFrame, facts: DataFrame, vectors: DataFrame, axis: tuple | None = None) -> DataFrame:
    """(qid, scope, idx, cosine, z) of queries (qid, scope, query) and the last WINDOW facts (scope, idx, t) of
    their scope that have a vector; z is the fact's place on an axis (w, c), else null.  Each query with a
    vector has one more row, whose idx is null.

    A scope's texts meet in one task, where only numbers leave: vectors are neither stored nor shuffled.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    q = queries.select("scope", F.col("qid"), F.lit(None).cast(facts.schema["idx"].dataType).alias("idx"), T.semantic_tokens(F.col("query")).alias("_ts"))
    f = facts.join(queries.select("scope").distinct(), "scope", "left_semi").select("scope", F.lit(None).cast(queries.schema["qid"].dataType).alias("qid"), "idx", T.semantic_tokens(F.col("t")).alias("_ts"))
    both = q.unionByName(f).where(F.size("_ts") > 0)
    kind = StructType([queries.schema["qid"], q.schema["scope"], q.schema["idx"], StructField("cosine", DoubleType()), StructField("z", DoubleType())])
    kind = StructType([StructField(x.name, x.dataType) for x in kind.fields])
    arrow = to_arrow_schema(kind)
    line = None if axis is None else (np.array(axis[0], dtype=np.float64), float(axis[1]))

    def out(qids, scope, idx, cosine, z):
        n = len(qids)
        cols = [pa.array(qids, arrow.field(0).type), pa.array([scope] * n, arrow.field(1).type), pa.array(idx, arrow.field(2).type), pa.array(cosine, pa.float64()), pa.array(z, pa.float64())]
        return pa.RecordBatch.from_arrays(cols, schema=arrow)

    def run(batches):
        words, at, asked, top = _Words(DIM), None, [], None
        for group, text, b in _runs(batches):
            if not text:
                words.add(group, b)
                continue
            kept, vec = words.embed(group, b.column("_ts"))
            same = b.filter(pa.array(kept))
            scopes, qids, idx = (same.column(c).to_pylist() for c in ("scope", "qid", "idx"))
            cuts = [i for i in range(len(scopes)) if not i or scopes[i] != scopes[i - 1] or (idx[i] is None) != (idx[i - 1] is None)]
            for lo, hi in zip(cuts, [*cuts[1:], len(scopes)], strict=True):
                if scopes[lo] != at:
                    at, asked, top = scopes[lo], [], None
                if idx[lo] is None:
                    asked.append((qids[lo:hi], vec[lo:hi]))
                    yield out(qids[lo:hi], at, [None] * (hi - lo), [None] * (hi - lo), [None] * (hi - lo))
                    continue
                top = idx[lo] if top is None else top
                end = lo + sum(x > top - WINDOW for x in idx[lo:hi])  # the last facts come first
                z = [None] * (end - lo) if line is None else (vec[lo:end] @ line[0] - line[1]).tolist()
                for names, u in asked:
                    if end > lo:
                        cos = u @ vec[lo:end].T
                        yield out(np.repeat(np.array(names, dtype=object), end - lo).tolist(), at, idx[lo:end] * len(names), cos.ravel(), z * len(names))

    order = ["scope", F.col("idx").isNotNull(), F.desc("idx")]
    return _beside_words(both, vectors, _groups(queries.sparkSession, both.count()), ["scope"], order).mapInArrow(run, kind)


def window(facts: DataFrame, n: int = WINDOW) -> DataFrame:
    """Each scope's last n facts."""
    top = facts.groupBy("scope").agg(F.max("idx").alias("top"))
    return facts.join(top, "scope").where(F.col("idx") > F.col("top") - n).drop("top")


def similar(queries: DataFrame, facts: DataFrame, gate: DataFrame | None = None) -> DataFrame:
    """(qid, scope, idx, cosine) of every candidate; gate is (qid, scope, idx) for the queries that it widens."""
    q = queries.select("qid", "scope", F.col("vec").alias("qv"))
    cosine = dot(F.col("qv"), F.col("vec")).alias("cosine")
    if gate is None:
        return q.join(window(facts), "scope").select("qid", "scope", "idx", cosine)
    gated = gate.select("qid", "scope").distinct()
    plain = q.join(gated, ["qid", "scope"], "left_anti").join(window(facts), "scope")
    wide = q.join(gate.select("qid", "scope", "idx"), ["qid", "scope"]).join(facts, ["scope", "idx"])
    return plain.select("qid", "scope", "idx", cosine).unionByName(wide.select("qid", "scope", "idx", cosine))


def recall_semantic(queries: DataFrame, facts: DataFrame, gate: DataFrame | None = None, near: float = NEAR) -> DataFrame:
    """(qid, scope, idx, cosine): the nearest fact, where it is near enough and, among FIELD candidates or
    more, stands clear of the middle of the field."""
    return standing(similar(queries, facts, gate), near)


def standing(every: DataFrame, near: float = NEAR) -> DataFrame:
    """recall_semantic from the cosines (qid, scope, idx, cosine) of all candidates."""
    every = every.withColumn("r", F.round("cosine", 9))
    down = Window.partitionBy("qid", "scope").orderBy(F.desc("r"), "idx")
    ranked = every.withColumns({"rank": F.row_number().over(down), "n": F.count(F.lit(1)).over(Window.partitionBy("qid", "scope"))})
    middle = F.max(F.when(F.col("rank") == F.floor(F.col("n") / 2) + 1, F.col("r")))
    by = ranked.groupBy("qid", "scope").agg(F.max("n").alias("n"), middle.alias("middle"), F.max(F.when(F.col("rank") == 1, F.struct("r", "idx"))).alias("top"))
    clear = (F.col("n") < FIELD) | (F.col("top.r") - F.col("middle") >= CLEAR)
    return by.where((F.col("top.r") >= near) & clear).select("qid", "scope", F.col("top.idx").alias("idx"), F.col("top.r").alias("cosine"))


def recall_durable(queries: DataFrame, episodes, embedded_queries: DataFrame, embedded_facts: DataFrame, gate: DataFrame | None = None) -> DataFrame:
    """The lexical answer of each query, and for queries without one the semantic one (coverage: its cosine)."""
    index = lexical.indexed(episodes)
    found = cut(lexical.recall(queries, index))
    missed = embedded_queries.join(found.select("qid", "scope"), ["qid", "scope"], "left_anti")
    return _with_meaning(found, recall_semantic(missed, embedded_facts, gate), index)


def recall_durable_texts(queries: DataFrame, episodes, vectors: DataFrame) -> DataFrame:
    """recall_durable of texts and word vectors: only queries without a lexical answer are embedded."""
    index = lexical.indexed(episodes)
    found = cut(lexical.recall(queries, index))
    missed = queries.join(found.select("qid", "scope"), ["qid", "scope"], "left_anti")
    every = cosines(missed, index.episodes.select("scope", "idx", "t"), vectors).where("idx IS NOT NULL")
    return _with_meaning(found, standing(every), index)


def _with_meaning(found: DataFrame, meant: DataFrame, index) -> DataFrame:
    more = meant.join(index.episodes.select("scope", "idx", "t", "v"), ["scope", "idx"])
    cols = {"rank": F.lit(1), "fact": F.col("t"), "value": F.col("v"), "coverage": F.col("cosine"), "overlap": F.lit(0), "exact": F.lit(0), "echo": F.lit(False)}
    return found.select(lexical.HIT).unionByName(more.withColumns(cols).select(lexical.HIT))


def word_hits(queries: DataFrame, facts: DataFrame) -> DataFrame:
    """(qid, scope, idx, hits): how many of a query's words of three bytes or more stand inside a fact's text."""
    words = F.filter(F.split(F.lower("query"), r"[^\p{L}\p{N}]+"), lambda w: F.octet_length(w) >= 3)
    both = queries.select("qid", "scope", words.alias("ws")).join(facts.select("scope", "idx", F.lower("t").alias("low")), "scope")
    hits = F.size(F.filter("ws", lambda w: F.contains(F.col("low"), w)))
    return both.select("qid", "scope", "idx", hits.alias("hits")).where("hits > 0")


def recall_blended(queries: DataFrame, facts: DataFrame, embedded_queries: DataFrame, embedded_facts: DataFrame, k: int, axis: tuple | None = None, gate: DataFrame | None = None) -> DataFrame:
    """(qid, scope, rank, idx, score): reciprocal ranks of word hits, of cosines and, given an axis (w, c), of
    what lies on its helpful side, summed; the best k.  Queries without a vector give no row here."""
    near = cut(similar(embedded_queries, embedded_facts, gate))
    helped = None
    if axis is not None:
        w, c = axis
        z = dot(F.col("vec"), F.array(*[F.lit(float(x)) for x in w])) - float(c)
        helped = near.join(embedded_facts.select("scope", "idx", z.alias("z")), ["scope", "idx"])
    return _blend(queries, window(facts) if gate is None else facts, near, embedded_queries, helped, k)


def recall_blended_texts(queries: DataFrame, facts: DataFrame, vectors: DataFrame, k: int, axis: tuple | None = None) -> DataFrame:
    """recall_blended of texts and word vectors, among each scope's last facts."""
    every = written(cosines(queries, facts, vectors, axis))
    near = every.where("idx IS NOT NULL")
    return _blend(queries, window(facts), near, every.where("idx IS NULL"), near if axis is not None else None, k)


def _blend(queries: DataFrame, pool: DataFrame, near: DataFrame, known: DataFrame, helped: DataFrame | None, k: int) -> DataFrame:
    """The fused order of cosines (near), word hits among a pool of facts and places on an axis (helped: z)."""
    keys = ["qid", "scope"]
    order = lambda *by: F.row_number().over(Window.partitionBy(*keys).orderBy(*by))
    hits = word_hits(queries.join(known.select(*keys), keys, "left_semi"), pool)
    lists = [near.select(*keys, "idx", order(F.desc(F.round("cosine", 9)), "idx").alias("rank")), hits.select(*keys, "idx", order(F.desc("hits"), "idx").alias("rank"))]
    if helped is not None:
        lists.append(helped.where("z > 0").select(*keys, "idx", order(F.desc(F.round("z", 9)), "idx").alias("rank")))
    every = reduce(DataFrame.unionByName, lists)
    total = every.groupBy(*keys, "idx").agg(F.sum(1.0 / (FUSION + F.col("rank"))).alias("score"))
    best = total.withColumn("rank", order(F.desc(F.round("score", 9)), "idx")).where(F.col("rank") <= k)
    return best.select(*keys, "rank", "idx", "score")


def outcome_texts(facts: DataFrame, matches: DataFrame, outcome: str, most: int = 16) -> DataFrame:
    """(scope, idx, t, class): the first facts, most a match, that a strengthening ('+') or a targeted
    forgetting ('-') touched; typed sub-scopes teach nothing."""
    plain = ~F.contains("scope", F.lit("::"))
    met = facts.where(plain).join(matches.select("scope", F.lower("match").alias("m")), "scope").where(F.contains(F.lower("t"), F.col("m")))
    first = F.row_number().over(Window.partitionBy("scope", "m").orderBy("idx"))
    return met.withColumn("r", first).where(F.col("r") <= most).select("scope", "idx", "t", F.lit(outcome).alias("class"))


def scope_samples(facts: DataFrame) -> DataFrame:
    """(scope, idx, t, class): a sixteenth of all facts, labelled by the family of their scope; typed
    sub-scopes teach nothing."""
    plain = facts.where(~F.contains("scope", F.lit("::")) & sampled(F.col("t")))
    return plain.select("scope", "idx", "t", F.concat(F.lit("scope:"), family(F.col("scope"))).alias("class"))


def axis_words(words: DataFrame, w, m: int) -> DataFrame:
    """(side, rank, id, cosine): the m words nearest to an axis and to its opposite."""
    from .vectors import nearest

    spark = words.sparkSession
    ends = spark.createDataFrame([("+", [float(x) for x in w]), ("-", [-float(x) for x in w])], "qid string, vec array<double>")
    return nearest(words, ends, m, skip_same=False).withColumnRenamed("qid", "side")
