"""Meaning by company: random-indexing word vectors, text embeddings, nearest vectors, projections."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..functions.hashing import fnv
from ..plans.lineage import cut

# The shape of index vectors and the step between their draws.
DIM, NONZERO, REACH = 256, 12, 5
DRAW_STEP = 0x100000001B3
#: Tokens whose sums a task holds at a time, and texts whose words it looks up together.
STRETCH, BLOCK = 1 << 15, 1000


def _splitmix(x: np.ndarray) -> np.ndarray:
    z = x + np.uint64(0x9E3779B97F4A7C15)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def index_entries(words: list[str], dim: int = DIM) -> np.ndarray:
    """Signed positions of each word's index vector: (pos + 1) * sign, one row a word."""
    seeds = fnv([w.encode() for w in words])[:, None]
    k = np.arange(NONZERO, dtype=np.uint64) * np.uint64(DRAW_STEP)
    r = _splitmix(seeds ^ k[None, :])
    sign = np.where((r >> np.uint64(33)) & np.uint64(1) == 0, 1, -1)
    return ((r % np.uint64(dim)).astype(np.int64) + 1) * sign


def cooccurrence(texts: DataFrame, text_col: str = "text") -> DataFrame:
    """(word, neighbour, n): how often two tokens stand within REACH places; counts add up exactly."""
    tok = texts.select(T.semantic_tokens(F.col(text_col)).alias("ts")).where(F.size("ts") > 0)
    at = tok.select("ts", F.posexplode("ts").alias("i", "word"))
    near = F.concat(F.slice("ts", F.greatest(F.col("i") - REACH, F.lit(0)) + 1, F.least(F.col("i"), F.lit(REACH))), F.slice("ts", F.col("i") + 2, REACH))
    return at.select("word", F.explode(near).alias("neighbour")).groupBy("word", "neighbour").agg(F.count(F.lit(1)).alias("n"))


def word_counts(texts: DataFrame, text_col: str = "text") -> DataFrame:
    return texts.select(F.explode(T.semantic_tokens(F.col(text_col))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def pack_sums(words: list[str], sums: np.ndarray) -> pa.RecordBatch:
    """(word, d, x) of rows of whole numbers: places that aren't zero, a byte each, and the numbers there in
    the fewest bytes that hold the largest; rows of zeros go."""
    at, dim = np.nonzero(sums)
    vals = sums[at, dim].astype(np.int64)
    row, start = np.unique(at, return_index=True)
    ends = np.append(start[1:], len(at))
    top = np.maximum.reduceat(np.abs(vals), start) if len(at) else np.zeros(0, np.int64)
    size = np.select([top < 1 << 7, top < 1 << 15, top < 1 << 31], [1, 2, 4], 8)
    raw, held = dim.astype(np.uint8).tobytes(), {}
    for k in set(size.tolist()):
        held[k] = vals.astype(f"<i{k}").tobytes()  # only read where the numbers fit
    d = [raw[a:b] for a, b in zip(start, ends, strict=True)]
    x = [held[k][a * k : b * k] for k, a, b in zip(size.tolist(), start, ends, strict=True)]
    return pa.RecordBatch.from_arrays([pa.array([words[i] for i in row], pa.string()), pa.array(d, pa.binary()), pa.array(x, pa.binary())], names=["word", "d", "x"])


def unpack_sums(d: list[bytes], x: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, place and number of every entry of packed rows."""
    n = np.array([len(v) for v in d], np.int64)
    size = np.array([len(v) for v in x], np.int64) // np.maximum(n, 1)
    vals = np.empty(int(n.sum()), np.int64)
    for k in (1, 2, 4, 8):
        if (size == k).any():
            vals[np.repeat(size == k, n)] = np.frombuffer(b"".join(v for v, m in zip(x, size == k, strict=True) if m), f"<i{k}")
    return np.repeat(np.arange(len(d)), n), np.frombuffer(b"".join(d), np.uint8).astype(np.int64), vals


PACKED = "word string, d binary, x binary"


def train_packed(texts: DataFrame, text_col: str = "text") -> DataFrame:
    """(word, d, x): context vectors, sums of neighbours' index vectors (exact integers), a packed row a word.

    Each task adds up what its own texts give, a stretch of tokens at a time; one packed row for each word of
    a stretch is shuffled, so a frequent word is no more than its stretches.
    """
    tok = texts.select(T.semantic_tokens(F.col(text_col)).alias("ts")).where(F.size("ts") > 0)

    def parts(batches):
        for b in (whole.slice(i, BLOCK) for whole in batches for i in range(0, whole.num_rows, BLOCK)):
            ts = b.column(0)
            of = np.repeat(np.arange(b.num_rows), pc.list_value_length(ts).to_numpy())
            word = ts.flatten().dictionary_encode()
            codes, names = word.indices.to_numpy().astype(np.int64), word.dictionary.to_pylist()
            entries = index_entries(names)
            place, sign = np.abs(entries) - 1, np.sign(entries).astype(np.float64)
            for lo in range(0, len(codes), STRETCH):
                here = np.arange(lo, min(lo + STRETCH, len(codes)))
                own, inv = np.unique(codes[here], return_inverse=True)
                sums = np.zeros(len(own) * DIM)
                for step in [s for s in range(-REACH, REACH + 1) if s]:
                    other = here + step
                    ok = (other >= 0) & (other < len(codes))
                    ok[ok] = of[other[ok]] == of[here[ok]]
                    near = codes[other[ok]]
                    flat = inv[ok][:, None] * DIM + place[near]
                    sums += np.bincount(flat.ravel(), weights=sign[near].ravel(), minlength=len(sums))
                yield pack_sums([names[i] for i in own], np.rint(sums, out=sums).reshape(-1, DIM))

    def total(batches):
        last, carry = None, None
        for b in batches:
            if not b.num_rows:
                continue
            word = b.column(0).dictionary_encode()
            codes, names = word.indices.to_numpy(), word.dictionary.to_pylist()
            row, dim, val = unpack_sums(b.column(1).to_pylist(), b.column(2).to_pylist())
            sums = np.zeros(len(names) * DIM, np.int64)
            np.add.at(sums, codes[row].astype(np.int64) * DIM + dim, val)
            sums = sums.reshape(-1, DIM)
            if names[0] == last:
                sums[0] += carry
            elif last is not None:
                yield pack_sums([last], carry[None, :])
            last, carry = names[-1], sums[-1]
            yield pack_sums(names[:-1], sums[:-1])
        if last is not None:
            yield pack_sums([last], carry[None, :])

    return tok.mapInArrow(parts, PACKED).repartition("word").sortWithinPartitions("word").mapInArrow(total, PACKED)


def packed(vectors: DataFrame) -> DataFrame:
    """Word vectors as packed rows, whether they come so or as (word, dim, val)."""
    if "x" in vectors.columns:
        return vectors

    def run(batches):
        for b in batches:
            n = pc.list_value_length(b.column(1)).to_numpy()
            sums = np.zeros((b.num_rows, DIM), np.int64)
            sums[np.repeat(np.arange(b.num_rows), n), b.column(1).flatten().to_numpy()] = b.column(2).flatten().to_numpy()
            yield pack_sums(b.column(0).to_pylist(), sums)

    by = vectors.groupBy("word").agg(F.collect_list(F.struct("dim", "val")).alias("v"))
    return by.select("word", "v.dim", F.col("v.val").cast("array<long>").alias("val")).mapInArrow(run, PACKED)


def train(texts: DataFrame, text_col: str = "text") -> DataFrame:
    """(word, dim, val): the context vectors as a row for each place that isn't zero."""

    def rows(batches):
        for b in batches:
            row, dim, val = unpack_sums(b.column(1).to_pylist(), b.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row)), pa.array(dim.astype(np.int32)), pa.array(val)], names=["word", "dim", "val"])

    return train_packed(texts, text_col).mapInArrow(rows, "word string, dim int, val long")


def merge_training(a: DataFrame, b: DataFrame) -> DataFrame:
    """Vectors learned from two corpora: sums, as if trained on both."""
    return a.unionByName(b).groupBy("word", "dim").agg(F.sum("val").alias("val")).where("val <> 0")


def embed(texts: DataFrame, vectors: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(id, dim, val): unit sums of the unit vectors of a text's known words."""
    unit = vectors.join(vectors.groupBy("word").agg(F.sqrt(F.sum(F.col("val") * F.col("val"))).alias("norm")), "word").select("word", "dim", (F.col("val") / F.col("norm")).alias("x"))
    tok = texts.select(F.col(id_col).alias("id"), F.explode(T.semantic_tokens(F.col(text_col))).alias("word")).groupBy("id", "word").agg(F.count(F.lit(1)).alias("n"))
    acc = tok.join(unit, "word").groupBy("id", "dim").agg(F.sum(F.col("n") * F.col("x")).alias("val"))
    norm = acc.groupBy("id").agg(F.sqrt(F.sum(F.col("val") * F.col("val"))).alias("norm")).where("norm > 0")
    return acc.join(norm, "id").select("id", "dim", (F.col("val") / F.col("norm")).alias("val"))


def pair_similarity(a: DataFrame, b: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a_id, b_id, cosine) of given pairs of embedded texts."""
    left = pairs.join(a.select(F.col("id").alias("a_id"), "dim", F.col("val").alias("x")), "a_id")
    both = left.join(b.select(F.col("id").alias("b_id"), "dim", F.col("val").alias("y")), ["b_id", "dim"])
    return both.groupBy("a_id", "b_id").agg(F.sum(F.col("x") * F.col("y")).alias("cosine"))


def standout(ranked: DataFrame, threshold: float = 0.20, margin: float = 0.10, least: int = 3) -> DataFrame:
    """(qid, item, cosine) to each query's best item, where it is close enough and, among enough
    candidates, above the middle of the field."""
    by = ranked.groupBy("qid").agg(F.max_by(F.struct("item", "cosine"), F.struct("cosine", (-F.col("item")).alias("i"))).alias("top"), F.sort_array(F.collect_list("cosine"), False).alias("cs"))
    middle = F.element_at("cs", (F.size("cs") / 2).cast("int") + 1)
    clear = (F.size("cs") < least) | (F.col("top.cosine") - middle >= margin)
    return by.where((F.col("top.cosine") >= threshold) & clear).select("qid", "top.item", "top.cosine")


def dot(a: Column, b: Column) -> Column:
    prods = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(prods, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def quantize(a: Column) -> Column:
    """struct(q, scale): int8 codes with one scale, the largest magnitude over 127."""
    top = F.array_max(F.transform(a, lambda x: F.abs(x.cast("double"))))
    scale = F.when(top > 0, top / 127).otherwise(1.0)
    code = lambda s: F.transform(a, lambda x: F.round(x.cast("double") / s).cast("int"))
    return T.bind(scale, lambda s: F.struct(code(s).alias("q"), s.alias("scale")))


def dequantize(q: Column) -> Column:
    return F.transform(q["q"], lambda x: x * q["scale"])


#: Queries that meet a shard's rows as one matrix, and rows of a shard.
QUERY_BLOCK, SHARD_ROWS = 2048, 65_536


def dense(vectors: DataFrame, id_cols: list[str], dim: int = DIM) -> DataFrame:
    """(id columns, vec): sparse (ids, dim, val) rows, or packed word vectors, as arrays of dim doubles."""
    if "x" in vectors.columns:

        def run(batches):
            for b in batches:
                for part in (b.slice(i, 1000) for i in range(0, b.num_rows, 1000)):
                    out = np.zeros((part.num_rows, dim))
                    row, at, val = unpack_sums(part.column(1).to_pylist(), part.column(2).to_pylist())
                    out[row, at] = val
                    offs = pa.array(np.arange(part.num_rows + 1, dtype=np.int32) * dim)
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(offs, pa.array(out.ravel()))], names=["word", "vec"])

        return vectors.select("word", "d", "x").mapInArrow(run, "word string, vec array<double>").select(F.col("word").alias(id_cols[0]), "vec")

    @F.pandas_udf("array<double>")
    def fill(ds: pd.Series, xs: pd.Series) -> pd.Series:
        out = np.zeros((len(ds), dim))
        for i, (d, x) in enumerate(zip(ds, xs, strict=True)):
            out[i, d] = x
        return pd.Series(list(out))

    by = vectors.groupBy(*id_cols).agg(F.collect_list(F.col("dim").cast("int")).alias("d"), F.collect_list(F.col("val").cast("double")).alias("x"))
    return by.select(*id_cols, fill("d", "x").alias("vec"))


def nearest(rows: DataFrame, queries: DataFrame, k: int, skip_same: bool = True) -> DataFrame:
    """(qid, rank, id, cosine): the k rows (id, vec) nearest to each query (qid, vec), smaller ids on ties.

    Rows are dealt into shards; queries go to every shard, meet its rows in blocks as matrix products and
    come back with the k best of the shard, so no other pair is ever a row.  With skip_same a row isn't
    near to itself.  Vectors without length are left out.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    total = rows.count()
    shards = max(1, min(parts, total), -(-total // SHARD_ROWS))
    qid, rid = queries.schema["qid"].dataType.simpleString(), rows.schema["id"].dataType.simpleString()
    kind = StructType.fromDDL(f"qid {qid}, id {rid}, cosine double")
    arrow = to_arrow_schema(kind)

    def best(ids, x, names, q):
        cos = q @ x.T
        if skip_same:
            cos[names[:, None] == ids[None, :]] = -np.inf
        at = np.argsort(np.round(-cos, 9), axis=1, kind="stable")[:, :k]
        row, col = np.repeat(np.arange(len(names)), at.shape[1]), at.ravel()
        ok = np.isfinite(cos[row, col])
        row, col = row[ok], col[ok]
        return pa.RecordBatch.from_arrays([pa.array(names[row].tolist(), arrow.field(0).type), pa.array(ids[col].tolist(), arrow.field(1).type), pa.array(cos[row, col])], schema=arrow)

    def unit(vs):
        x = np.vstack(vs)
        norm = np.linalg.norm(x, axis=1)
        if not (norm > 0).all():
            x = x[norm > 0]
        x /= norm[norm > 0][:, None]
        return x, norm > 0

    def run(batches):
        """Rows by shard, the shard's own (role 0, by id) before the queries."""
        cur, ids, vs, names, qs, table = None, [], [], [], [], None

        def flush():
            nonlocal names, qs, table
            if not qs or not vs:
                names, qs = [], []
                return
            if table is None:
                x, ok = unit(vs)
                table = np.array(ids, dtype=object)[ok], x
                vs[1:] = []  # held in the table
            q, ok = unit(qs)
            named = np.array(names, dtype=object)[ok]
            names, qs = [], []
            if len(named) and len(table[0]):
                yield best(*table, named, q)

        for b in batches:
            n = b.num_rows
            cols = [*(b.column(i).to_pylist() for i in range(4)), b.column(4).flatten().to_numpy().reshape(n, -1).copy() if n else []]
            for shard, role, id_, name, vec in zip(*cols, strict=True):
                if shard != cur:
                    yield from flush()
                    cur, ids, vs, table = shard, [], [], None
                if role == 0:
                    ids.append(id_)
                    vs.append(vec)
                else:
                    names.append(name)
                    qs.append(vec)
                    if len(qs) >= QUERY_BLOCK:
                        yield from flush()
        yield from flush()

    own = rows.select(F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int").alias("shard"), F.lit(0).alias("role"), "id", F.lit(None).cast(qid).alias("qid"), "vec")
    asked = queries.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(1).alias("role"), F.lit(None).cast(rid).alias("id"), "qid", "vec")
    dealt = own.unionByName(asked).repartition(shards, "shard").sortWithinPartitions("shard", "role", "id")
    order = Window.partitionBy("qid").orderBy(F.desc(F.round("cosine", 9)), "id")
    ranked = dealt.mapInArrow(run, kind).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("qid", "rank", "id", "cosine")


def axis_rank(rows: DataFrame, w, c: float) -> DataFrame:
    """(id, z, rank): rows (id, vec) by their place on an axis, z = w . x - c, highest first."""
    from ..plans.numbering import numbered

    z = dot(F.col("vec"), F.array(*[F.lit(float(x)) for x in w])) - c
    return numbered(rows.select("id", z.alias("z"), (-z).alias("_down")), ["_down", "id"], "rank").drop("_down")


def semantic_totals(vectors: DataFrame, counts: DataFrame) -> DataFrame:
    """One row: words with a vector, tokens read, and bytes of the vectors at four a component."""
    v = vectors.agg(F.countDistinct("word").alias("words"))
    return counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("tokens")).join(F.broadcast(v)).select("words", "tokens", (F.col("words") * DIM * 4).alias("bytes"))


def _rows_at(unit: DataFrame, places: list[int]) -> list[list[float]]:
    """Vectors of the rows at some places of the id order, found by counts of range partitions.

    The partitions are written before they are counted: ranges are cut by a sample, and another run
    may draw another one.
    """
    ranged = cut(unit.select("id").repartitionByRange(64, "id").withColumn("p", F.spark_partition_id()))
    counts = {r["p"]: r["n"] for r in ranged.groupBy("p").agg(F.count(F.lit(1)).alias("n")).collect()}
    base, first = [], 0
    for p in sorted(counts):
        base += [F.lit(p), F.lit(first)]
        first += counts[p]
    at = F.row_number().over(Window.partitionBy("p").orderBy("id")) - 1 + F.element_at(F.create_map(*base), F.col("p"))
    wanted = ranged.select("id", at.cast("long").alias("r")).where(F.col("r").isin(places))  # k rows at most
    found = unit.join(F.broadcast(wanted.withColumnRenamed("id", "_id")), F.col("id").eqNullSafe(F.col("_id")))
    return [r["u"] for r in found.groupBy("r").agg(F.min("u").alias("u")).orderBy("r").collect()]


def kmeans(vectors: DataFrame, k: int, iterations: int = 8, id_col: str = "id", vec_col: str = "vec") -> DataFrame:
    """(id, cluster) by cosine k-means over unit vectors, seeded with rows n * c / k in id order.

    Only the k centres move between steps; rows are read, never gathered.
    """
    unit = vectors.select(F.col(id_col).alias("id"), T.bind(norm(F.col(vec_col)), lambda n: F.transform(vec_col, lambda x: x / F.greatest(n, F.lit(1e-9)))).alias("u"))
    n = unit.count()
    if n == 0:
        return unit.select("id", F.lit(0).cast("int").alias("cluster"))
    k = min(k, n)
    want = sorted({n * c // k for c in range(k)})
    centres = np.array(_rows_at(unit, want), dtype=np.float64)

    def sums(c):
        def run(batches):
            total, count = np.zeros_like(c), np.zeros(len(c))
            for b in batches:
                u = np.array(b.column(0).to_pylist(), dtype=np.float64).reshape(b.num_rows, c.shape[1])
                a = (u @ c.T).argmax(1)
                np.add.at(total, a, u)
                count += np.bincount(a, minlength=len(c))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(c))), pa.array(count), pa.array([row.tolist() for row in total], pa.list_(pa.float64()))], names=["c", "n", "s"])

        return unit.select("u").mapInArrow(run, "c long, n double, s array<double>")

    for _ in range(iterations - 1):
        # k rows of partial sums a partition are added up in the cluster; k rows come back.
        add = sums(centres).select("c", "n", F.posexplode("s").alias("d", "x")).groupBy("c", "d").agg(F.sum("x").alias("x"), F.sum("n").alias("n")).collect()
        new, seen = np.zeros_like(centres), np.zeros(len(centres))
        for r in add:
            new[r["c"], r["d"]] = r["x"]
            seen[r["c"]] = r["n"]
        size = np.maximum(np.linalg.norm(new, axis=1), 1e-9)
        centres = np.where((seen > 0)[:, None], new / size[:, None], centres)

    def nearest(batches):
        for b in batches:
            u = np.array(b.column(1).to_pylist(), dtype=np.float64).reshape(b.num_rows, centres.shape[1])
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array((u @ centres.T).argmax(1).astype(np.int32))], names=["id", "cluster"])

    return unit.select("id", "u").mapInArrow(nearest, "id long, cluster int")


def moments(vectors: DataFrame, vec_col: str = "vec") -> tuple[int, np.ndarray, np.ndarray]:
    """Count, sum and second-moment matrix of a vector column; partitions send one matrix each."""

    def run(batches):
        n, s, q = 0, None, None
        for b in batches:
            x = np.array(b.column(0).to_pylist(), dtype=np.float64)
            if len(x):
                n += len(x)
                s = x.sum(0) if s is None else s + x.sum(0)
                q = x.T @ x if q is None else q + x.T @ x
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([s.tolist()], pa.list_(pa.float64())), pa.array([q.ravel().tolist()], pa.list_(pa.float64()))], names=["n", "s", "q"])

    part = vectors.select(vec_col).mapInArrow(run, "n long, s array<double>, q array<double>")
    total = part.agg(F.sum("n")).first()[0] or 0
    add = lambda c: [r["x"] for r in part.select(F.posexplode(c).alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x")).orderBy("i").collect()]
    s, q = np.array(add("s")), np.array(add("q"))
    return total, s, q.reshape(len(s), len(s)) if len(s) else q


def project(vectors: DataFrame, k: int = 3, id_col: str = "id", vec_col: str = "vec") -> tuple[DataFrame, list[float], float]:
    """(id, coords) on the k leading principal axes, their variances and the total variance."""
    n, s, q = moments(vectors, vec_col)
    mean = s / n
    cov = q / n - np.outer(mean, mean)
    value, axes = np.linalg.eigh(cov)
    order = np.argsort(-value)[:k]
    axes = axes[:, order].T
    axes *= np.sign(axes[np.arange(len(axes)), np.abs(axes).argmax(1)])[:, None]  # largest entry positive

    def coords(batches):
        for b in batches:
            x = np.array(b.column(1).to_pylist(), dtype=np.float64).reshape(b.num_rows, len(mean))
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(((x - mean) @ axes.T).tolist(), pa.list_(pa.float64()))], names=["id", "coords"])

    out = vectors.select(F.col(id_col).alias("id"), vec_col).mapInArrow(coords, "id long, coords array<double>")
    return out, value[order].tolist(), float(np.trace(cov))
