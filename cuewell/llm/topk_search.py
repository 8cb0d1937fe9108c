"""Operator 3: exact top-k by integer inner product, ball trees and branch and bound.

Vectors are dealt into cells by their nearest pivot, so that a cell is a ball; cells of more than
SHARD_ROWS rows are split by a hash of the key.  Each shard builds a ball tree.  A ball's inner
product with a query is at most q.centre + |q| * radius.  Branch and bound runs on two levels:

1. Every query searches its own shard first.  Its k-th score there is shared: the query is sent on
   only to shards of cells whose bound reaches it, so the others are dropped before the shuffle.
2. In a shard a block of queries walks the tree from the root, the node of the highest bound first; a
   node is left by the queries whose k-th score its bound doesn't reach, and opened for the rest.
   Results raise the k-th scores while the walk goes on.

Pivots come from a bounded sample (SAMPLE rows of smallest key hash) and decide speed only: every row
is dealt and every bound holds for all rows of its cell.

Vectors that are null, or hold null or non-finite components, and rows with a null id take no part.
Components become floor(64 * x).  Vectors of different lengths are compared as if padded with zeros.
Equal scores go to the smaller id, which pruning respects: a node is left only if its bound is
strictly lower.  Every row is a vector of its own, repeated ids included: each is a partner, and each
is a query with k ranks of its own, from which only the row itself is left out.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .keys import keyed
from .lineage import cut

LEAF = 256
QUERY_BLOCK = 1024
SHARD_ROWS = 32_768
MAX_CELLS, SAMPLE, ROUNDS = 1024, 8192, 6


class Tree:
    """A ball tree: centre and radius of every node, two children or a range of perm each."""

    def __init__(self, x: np.ndarray):
        self.x, self.perm = x, np.arange(len(x))
        centre, radius, self.child, self.span = [], [], [], []
        todo = [(0, len(x), -1, 0)]
        while todo:
            a, b, parent, side = todo.pop()
            pts = x[self.perm[a:b]]
            c = pts.mean(0)
            at = len(centre)
            if parent >= 0:
                self.child[parent][side] = at
            centre.append(c)
            far2 = ((pts - c) ** 2).sum(1)
            radius.append(np.sqrt(far2.max()))
            self.child.append([-1, -1])
            self.span.append((a, b))
            if b - a > LEAF and radius[-1] > 0:
                # Split at the median between two far points; the depth stays logarithmic.
                far = pts[far2.argmax()]
                other = pts[((pts - far) ** 2).sum(1).argmax()]
                mid = (b - a) // 2
                self.perm[a:b] = self.perm[a:b][np.argpartition(pts @ (other - far), mid)]
                todo += [(a, a + mid, at, 0), (a + mid, b, at, 1)]
        self.centre, self.radius = np.array(centre), np.array(radius)

    def bounds(self, node: int, q: np.ndarray, norm: np.ndarray) -> np.ndarray:
        b = q @ self.centre[node] + norm * self.radius[node]
        return b + 1e-6 * (1.0 + np.abs(b))  # rounding of the bound itself


class _Best:
    """The k best of each query of a block, by score, id and key."""

    def __init__(self, n: int, kth: np.ndarray, k: int):
        self.k, self.kth = k, kth.astype(np.float64).copy()
        self.cols = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        self.found, self.size = [], 0

    def add(self, row, cid, key, score):
        self.found.append((row, cid, key, score))
        self.size += len(row)
        if self.size > 64 * QUERY_BLOCK:
            self.settle()

    def settle(self):
        row, cid, key, score = (np.concatenate([c, *[f[i] for f in self.found]]) for i, c in enumerate(self.cols))
        self.found, self.size = [], 0
        order = np.lexsort((key, cid, -score, row))
        row, cid, key, score = row[order], cid[order], key[order], score[order]
        place = np.arange(len(row)) - np.searchsorted(row, row, "left")
        last = place == self.k - 1
        self.kth[row[last]] = np.maximum(self.kth[row[last]], score[last])
        keep = place < self.k
        self.cols = [row[keep], cid[keep], key[keep], score[keep]]


def search(tree: Tree, ids, keys, q, q_keys, kth, k):
    """(query row, id, key, score) that hold the k best of one shard for a block of queries.

    kth: scores that a result must reach.  Nodes are taken by the highest bound of any query.
    """
    best, norm = _Best(len(q), kth, k), np.sqrt((q**2).sum(1))
    root = tree.bounds(0, q, norm)
    heap = [(-root.max(), 0, np.arange(len(q)), root)]
    seen = 0
    while heap:
        _, node, live, bound = heapq.heappop(heap)
        still = bound >= best.kth[live]
        live = live[still]
        if not len(live):
            continue
        a, b = tree.span[node]
        if tree.child[node][0] >= 0:
            for c in tree.child[node]:
                bound = tree.bounds(c, q[live], norm[live])
                ok = bound >= best.kth[live]
                if ok.any():
                    heapq.heappush(heap, (-bound[ok].max(), c, live[ok], bound[ok]))
            continue
        at = tree.perm[a:b]
        score = q[live] @ tree.x[at].T
        r, c = np.nonzero(score >= best.kth[live][:, None])
        other = keys[at[c]] != q_keys[live[r]]
        r, c = r[other], c[other]
        best.add(live[r], ids[at[c]], keys[at[c]], score[r, c])
        seen += 1
        if seen % 4 == 0:
            best.settle()
    best.settle()
    return best.cols


def pivots_of(sample: np.ndarray, cells: int) -> np.ndarray:
    """Centres of the sample's clusters: a few rounds of k-means from evenly dealt rows."""
    c = sample[np.linspace(0, len(sample) - 1, cells).astype(int)].copy()
    for _ in range(ROUNDS):
        near = _nearest(sample, c)[0]
        for j in range(cells):
            own = sample[near == j]
            if len(own):
                c[j] = own.mean(0)
    return c


def _nearest(x: np.ndarray, c: np.ndarray):
    """Number of the nearest centre of each row, and the distance."""
    d = (x**2).sum(1)[:, None] - 2 * (x @ c.T) + (c**2).sum(1)[None, :]
    near = d.argmin(1)
    return near, np.sqrt(np.maximum(((x - c[near]) ** 2).sum(1), 0))


def _matrix(col, width: int) -> np.ndarray:
    """A list column as rows of one width, padded with zeros."""
    offs = col.offsets.to_numpy()
    flat = col.values.to_numpy(zero_copy_only=False)
    n = len(col)
    lens = offs[1 : n + 1] - offs[:n]
    if (lens == width).all():
        return flat[offs[0] : offs[n]].reshape(n, width)
    out = np.zeros((n, width))
    for i in range(n):
        out[i, : lens[i]] = flat[offs[i] : offs[i + 1]]
    return out


def _lists(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))


_ROW = "shard int, role int, key long, id long, x array<double>, kth double"
_NAMES = [c.split()[0] for c in _ROW.split(", ")]


def top_k(df, is_query, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", shard_rows: int = SHARD_ROWS):
    """query_id, rank, vec_id and score of the k best partners of every row for which is_query holds."""
    x = F.transform(F.col(vec_col), lambda v: F.floor(v.cast("double") * 64).cast("double"))
    finite = F.forall(F.col(vec_col), lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = df.where(F.col(vec_col).isNotNull() & F.col(id_col).isNotNull() & finite).select(F.col(id_col).cast("long").alias("id"), x.alias("x"))
    rows, names = keyed(rows, "id")
    rows = rows.select("key", "id", "x")
    n, width = rows.agg(F.count(F.lit(1)), F.max(F.size("x"))).first()
    width = width or 0
    cells = max(1, min(MAX_CELLS, -(-n // shard_rows)))
    # A bounded sample; the cut by hash before it keeps what partitions send as small.
    share = min(1.0, 4 * SAMPLE / max(n, 1))
    drawn = rows.select("x", F.pmod(F.xxhash64("key"), F.lit(1 << 30)).alias("h"), "key").where(F.col("h") <= int(share * (1 << 30)))
    sample = drawn.orderBy("h", "key").limit(SAMPLE).collect()
    first = np.zeros((max(1, len(sample)), width))
    for i, r in enumerate(sample):
        first[i, : len(r["x"])] = r["x"]
    centres = pivots_of(first, min(cells, len(first)))

    def measure(batches):
        for b in batches:
            near, far = _nearest(_matrix(b.column(0), width), centres)
            yield pa.RecordBatch.from_arrays([pa.array(near.astype(np.int32)), pa.array(far)], names=["cell", "far"])

    found = rows.select("x").mapInArrow(measure, "cell int, far double").groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("r")).collect()  # MAX_CELLS rows at most
    radius, splits = np.zeros(len(centres)), np.zeros(len(centres), np.int64)
    for r in found:
        radius[r["cell"]], splits[r["cell"]] = r["r"], -(-r["n"] // shard_rows)
    base = np.concatenate([[0], np.cumsum(splits)])
    shards = max(1, int(base[-1]))

    def home_of(keys, near):
        part = (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)).astype(np.int64)
        return base[near] + part % np.maximum(splits[near], 1)

    def deal(role: int):
        """Rows to their own shards."""

        def run(batches):
            for b in batches:
                keys, m = b.column(0).to_numpy(), _matrix(b.column(2), width)
                home = home_of(keys, _nearest(m, centres)[0])
                n = len(keys)
                yield pa.RecordBatch.from_arrays([pa.array(home.astype(np.int32)), pa.array(np.full(n, role, np.int32)), b.column(0), b.column(1), _lists(m), pa.nulls(n, pa.float64())], names=_NAMES)

        return run

    def send(batches):
        """Queries (key, id, x, k-th score) to the shards, but for their own, whose bound reaches the score."""
        for b in batches:
            keys, m = b.column(0).to_numpy(), _matrix(b.column(2), width)
            kth = np.array([-np.inf if v is None else v for v in b.column(3).to_pylist()], dtype=np.float64)
            home = home_of(keys, _nearest(m, centres)[0])
            bound = m @ centres.T + np.sqrt((m**2).sum(1))[:, None] * radius[None, :]
            bound += 1e-6 * (1.0 + np.abs(bound))
            for c in np.flatnonzero(splits):
                for s in range(base[c], base[c + 1]):
                    go = np.flatnonzero((bound[:, c] >= kth) & (home != s))
                    if len(go):
                        at = pa.array(go)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(len(go), s, np.int32)), pa.array(np.ones(len(go), np.int32)), b.column(0).take(at), b.column(1).take(at), _lists(m[go]), pa.array(kth[go])], names=_NAMES
                        )

    def run(batches):
        """Rows by shard, members (role 0) before queries, to the best pairs of each shard."""
        cur, tree, ids, keys = None, None, [], []
        members, asked = [], []

        def flush():
            nonlocal tree, ids, keys, members, asked
            if members:
                ids, keys = (np.concatenate([m[i] for m in members]) for i in (0, 1))
                tree, members = Tree(np.concatenate([m[2] for m in members])), []
            if not asked:
                return
            q_keys, q_ids, q, kth = (np.concatenate([a[i] for a in asked]) for i in range(4))
            asked = []
            if tree is not None:
                r, c, ck, s = search(tree, ids, keys, q, q_keys, kth, k)
                yield pa.RecordBatch.from_arrays([pa.array(q_keys[r]), pa.array(q_ids[r]), pa.array(c), pa.array(ck), pa.array(s.astype(np.int64))], names=["q", "query_id", "vec_id", "key", "score"])

        for b in batches:
            shard, role = b.column(0).to_numpy(), b.column(1).to_numpy()
            change = np.flatnonzero((np.diff(shard) != 0) | (np.diff(role) != 0)) + 1
            for a, z in zip(np.concatenate([[0], change]), np.concatenate([change, [len(shard)]]), strict=True):
                if a == z:
                    continue
                if shard[a] != cur:
                    yield from flush()
                    cur, tree, members, asked = shard[a], None, [], []
                part = b.slice(a, z - a)
                key, id_, m = part.column(2).to_numpy(), part.column(3).to_numpy(), _matrix(part.column(4), width)
                if role[a] == 0:
                    members.append((id_, key, m))
                    continue
                kth = np.array([-np.inf if v is None else v for v in part.column(5).to_pylist()], dtype=np.float64)
                for i in range(0, len(key), QUERY_BLOCK):
                    y = slice(i, i + QUERY_BLOCK)
                    asked.append((key[y], id_[y], m[y], kth[y]))
                    if sum(len(t[0]) for t in asked) >= QUERY_BLOCK:
                        yield from flush()
        yield from flush()

    member = rows.mapInArrow(deal(0), _ROW)
    queries = rows.where(is_query(F.col("id")))

    def visit(asked):
        both = member.unionByName(asked)
        dealt = both.repartition(shards, "shard").sortWithinPartitions("shard", "role")
        return dealt.mapInArrow(run, "q long, query_id long, vec_id long, key long, score long")

    w = Window.partitionBy("q").orderBy(F.col("score").desc(), F.col("vec_id"), F.col("key"))
    result = at_home = cut(visit(queries.mapInArrow(deal(1), _ROW)))
    if shards > 1:
        seen = at_home.withColumn("r", F.row_number().over(w)).where(F.col("r") == k).select(F.col("q").alias("key"), F.col("score").cast("double").alias("kth"))
        away = queries.join(seen, "key", "left").select("key", "id", "x", "kth").mapInArrow(send, _ROW)
        result = at_home.unionByName(visit(away))
    return result.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def query(spark, sf_dir: str):
    from .textblocks import read_table

    return top_k(read_table(spark, sf_dir, "embeddings"), lambda i: i % 20 == 0)


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS x
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         list_sum(list_transform(list_zip(q.x, c.x), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 20
"""
