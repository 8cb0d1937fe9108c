"""Operator 1: n-gram Jaccard join (exact), as a blocked sparse matrix product.

The matrix is documents by distinct word 5-grams.  Its entries are dealt by n-gram hash into
column blocks; a block counts how many documents each n-gram has and drops the n-grams of one
document, which can't add to any product.  What is left returns to its documents.  There the
entries stand in one global order (rarest first), and size-derived bounds drop what can't matter:
a document with n n-grams needs an overlap of at least ceil(75 (n + m) / 175) with a partner of m,
so only its first n - ceil(0.75 n) + 1 entries can hold the first one that a linked pair shares.
Documents without such an entry have no partner.

The product is accumulated in two blocked passes over what remains, one row for each distinct set
(equal sets are linked at once).  First every list's members against the list's smallest member,
whose links already join large groups of near copies; then every pair of a list whose members are
still in different components, under the bounds on size and position.  Overlaps are counted in
full in both.  So components are those of all links, while a group of k near copies costs about k
counts, not k * k.  N-grams are told apart by hashes of 40 bits and the block's number.

Numbers of links come from the product itself: every link lies inside a component, whose sets are
dealt into row blocks of bounded size.  Each pair of row blocks is multiplied, overlap counts adding
up over column blocks, and what passes the bounds on size and overlap is counted for both sides; no
pair becomes a row.

Null or empty text, or text of white space only: an empty set, linked with nothing.  Fewer than
five words: the whole sequence is the one shingle.  Every row is a document of its own, also where
its id is null or repeated; a component's id is the smallest id in it, null if it has none.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import ROWS_A_TASK, components
from .keys import keyed, named
from .lineage import cut, written
from .memory import releasing
from .textblocks import blocks, lower_ascii, mix, prefix_sums, span_hashes, word_spans

WORDS = 5
_MUL = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], dtype=np.uint64)
FLUSH = 1 << 21


def shingles(data: np.ndarray, offs: np.ndarray):
    """Distinct shingle hashes of each row of a block, grouped by row: (hashes, row offsets)."""
    low = lower_ascii(data)
    starts, ends, rows = word_spans(low, offs)
    n_rows = len(offs) - 1
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(n_rows + 1, np.int64)
    w = span_hashes(prefix_sums(low), starts, ends)
    row_at = np.searchsorted(rows, np.arange(n_rows + 1), "left")
    words = row_at[1:] - row_at[:-1]
    pad = np.concatenate([w, np.zeros(WORDS, np.uint64)])
    total = np.zeros(len(w), np.uint64)
    for k in range(WORDS):
        total += pad[k : k + len(w)] * _MUL[k]
    place = np.arange(len(w)) - row_at[rows]
    whole = place + WORDS <= words[rows]
    keep = np.flatnonzero(whole)
    hashes, owner = mix(total[keep]), rows[keep]
    for r in np.flatnonzero((words > 0) & (words < WORDS)).tolist():  # a few words: one shingle
        with np.errstate(over="ignore"):
            s = np.uint64(words[r]) * np.uint64(0xD6E8FEB86659FD93)
            for k in range(int(words[r])):
                s += w[row_at[r] + k] * _MUL[k]
        hashes = np.append(hashes, mix(np.array([s], np.uint64)))
        owner = np.append(owner, r)
    # One sort: the row in the high bits, what is left of the hash below, ties resolved on the whole.
    order = np.lexsort((hashes, owner)) if n_rows > 1 else np.argsort(hashes)
    h, o = hashes[order], owner[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (o[1:] != o[:-1])
    h, o = h[new], o[new]
    return h, np.searchsorted(o, np.arange(n_rows + 1), "left")


def _pack_ids(x: np.ndarray) -> bytes:
    """Integers as a base and the narrowest unsigned differences."""
    base = int(x.min()) if len(x) else 0
    d = (x - base).astype(np.uint64)
    top = int(d.max()) if len(x) else 0
    kind = next(t for t in ("<u2", "<u4", "<u8") if top <= np.iinfo(t).max)
    return np.array([base], "<i8").tobytes() + kind.encode() + d.astype(kind).tobytes()


def _unpack_ids(b: bytes) -> np.ndarray:
    return np.frombuffer(b, b[8:11].decode(), offset=11).astype(np.int64) + int(np.frombuffer(b, "<i8", 1)[0])


def _split(order_key: np.ndarray, n: int):
    """A stable order by key, and the offsets of keys 0..n-1 in it."""
    order = np.argsort(order_key, kind="stable")
    return order, np.searchsorted(order_key[order], np.arange(n + 1), "left")


_ROW = "bucket int, kind int, a binary, b binary, c binary"
_NAMES = ["bucket", "kind", "a", "b", "c"]


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()), strict=True)], names=_NAMES)


def _doc_bucket(doc: np.ndarray, n: int) -> np.ndarray:
    return (mix(doc.astype(np.uint64)) % np.uint64(n)).astype(np.int64)


def _deal_entries(bits: int):
    """First pass: documents to packed matrix entries by column block, and rows about documents."""
    n_buckets = 1 << bits

    def flush(hs, ds, meta):
        h, d = np.concatenate(hs), np.concatenate(ds)
        hs.clear()
        ds.clear()
        order, at = _split((h >> np.uint64(64 - bits)).astype(np.int64), n_buckets)
        # 40 bits below the block's number; with it, collisions stay as rare at every size.
        low = ((h[order] << np.uint64(bits)) >> np.uint64(24)).astype("<u8")
        d = d[order]
        del h, order
        rows = []
        for k in range(n_buckets):
            x = slice(at[k], at[k + 1])
            if at[k] < at[k + 1]:
                rows.append((k, 1, (low[x] & np.uint64(0xFFFFFFFF)).astype("<u4").tobytes(), (low[x] >> np.uint64(32)).astype(np.uint8).tobytes(), _pack_ids(d[x])))
        ids, n, f1, f2 = (np.concatenate(x) for x in zip(*meta, strict=True))
        order, at = _split(_doc_bucket(ids, n_buckets), n_buckets)
        for k in range(n_buckets):
            x = order[at[k] : at[k + 1]]
            if len(x):
                rows.append((k, 0, ids[x].astype("<i8").tobytes(), n[x].astype("<i8").tobytes(), np.concatenate([f1[x], f2[x]]).astype("<u8").tobytes()))
        return _rows(rows)

    @releasing
    def run(batches):
        h, d, meta, size = [], [], [], 0
        for b in batches:
            keys = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for lo, hi, data, offs in blocks(b.column(1)):
                x, at = shingles(data, offs)
                n = at[1:] - at[:-1]
                h.append(x)
                d.append(np.repeat(keys[lo:hi], n))
                sums = []
                for v in (x, mix(x ^ np.uint64(0x5851F42D4C957F2D))):
                    s = np.zeros(len(v) + 1, np.uint64)
                    np.cumsum(v, out=s[1:])
                    sums.append(s[at[1:]] - s[at[:-1]])
                meta.append((keys[lo:hi], n, *sums))
                size += len(x)
                if size >= FLUSH:
                    yield flush(h, d, meta)
                    h, d, meta, size = [], [], [], 0
        if meta:
            yield flush(h, d, meta)

    return run


def _groups(batches):
    """(bucket, rows) of each run of equal buckets."""
    cur, rows = None, []
    for b in batches:
        buckets = b.column(0).to_pylist()
        kinds = b.column(1).to_pylist()
        for i, k in enumerate(buckets):
            if k != cur:
                if rows:
                    yield cur, rows
                cur, rows = k, []
            rows.append((kinds[i], b.column(2)[i].as_py(), b.column(3)[i].as_py(), b.column(4)[i].as_py()))
    if rows:
        yield cur, rows


def _count_columns(bits: int):
    """Second pass: within a column block, keep n-grams of two documents or more, deal them by document."""
    n_buckets = 1 << bits

    def flush(hs, ds, fs, meta):
        """Entries of as many column blocks as the task has seen, dealt by document at once."""
        out = list(meta)
        if hs:
            h, docs, df = (np.concatenate(x) for x in (hs, ds, fs))
            for x in (hs, ds, fs):
                x.clear()
            order, at = _split(_doc_bucket(docs, n_buckets), n_buckets)
            h, docs, df = h[order].astype("<u8"), docs[order], df[order].astype("<u2")
            for k in np.flatnonzero(at[1:] > at[:-1]).tolist():
                x = slice(at[k], at[k + 1])
                out.append((k, 2, h[x].tobytes(), df[x].tobytes(), _pack_ids(docs[x])))
        return _rows(out)

    @releasing
    def run(batches):
        hs, ds, fs, meta, size = [], [], [], [], 0
        for bucket, rows in _groups(batches):
            entries = [r for r in rows if r[0] == 1]
            meta += [(bucket, 0, a, b, c) for k, a, b, c in rows if k == 0]
            if entries:
                low = np.concatenate([np.frombuffer(a, "<u4").astype(np.uint64) | (np.frombuffer(b, np.uint8).astype(np.uint64) << np.uint64(32)) for _, a, b, _ in entries])
                docs = np.concatenate([_unpack_ids(c) for *_, c in entries])
                order = np.argsort(low, kind="stable")
                low, docs = low[order], docs[order]
                new = np.ones(len(low), bool)
                new[1:] = low[1:] != low[:-1]
                group = np.cumsum(new) - 1
                df = np.bincount(group)[group]
                keep = df > 1
                hs.append(low[keep] | np.uint64(bucket) << np.uint64(40))
                ds.append(docs[keep])
                fs.append(np.minimum(df[keep], 65535))
                size += int(keep.sum())
            if size >= FLUSH:
                yield flush(hs, ds, fs, meta)
                hs, ds, fs, meta, size = [], [], [], [], 0
        yield flush(hs, ds, fs, meta)

    return run


_DOC = "doc_id long, n long, f1 long, f2 long, alone long, shared binary"


@releasing
def _gather_documents(batches):
    """Third pass: a document's shared entries, rarest first; null where no partner is possible."""
    for _, rows in _groups(batches):
        meta = [r for r in rows if r[0] == 0]
        if not meta:
            continue
        ids = np.concatenate([np.frombuffer(a, "<i8") for _, a, _, _ in meta])
        n = np.concatenate([np.frombuffer(b, "<i8") for _, _, b, _ in meta])
        f = [np.frombuffer(c, "<u8").reshape(2, -1) for *_, c in meta]
        f1, f2 = np.concatenate([x[0] for x in f]), np.concatenate([x[1] for x in f])
        entries = [r for r in rows if r[0] == 2]
        h = np.concatenate([np.frombuffer(a, "<u8") for _, a, _, _ in entries]) if entries else np.zeros(0, np.uint64)
        df = np.concatenate([np.frombuffer(b, "<u2") for _, _, b, _ in entries]) if entries else np.zeros(0, np.uint16)
        docs = np.concatenate([_unpack_ids(c) for *_, c in entries]) if entries else np.zeros(0, np.int64)
        order = np.lexsort((h, df, docs))
        h, docs = h[order], docs[order]
        lo, hi = np.searchsorted(docs, ids, "left"), np.searchsorted(docs, ids, "right")
        alone = n - (hi - lo)
        hope = (n > 0) & (alone <= n - _least_overlap(n))
        shared = [h[a:b].astype("<u8").tobytes() if ok else None for a, b, ok in zip(lo.tolist(), hi.tolist(), hope.tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids), pa.array(n), pa.array(f1.view(np.int64)), pa.array(f2.view(np.int64)), pa.array(alone), pa.array(shared, pa.binary())],
            names=[x.split()[0] for x in _DOC.split(", ")],
        )


def _least_overlap(n):
    """Smallest overlap of any partner of a document with n n-grams: ceil(0.75 n)."""
    return -(-3 * n // 4)


@releasing
def _prefix(batches):
    """(hash, doc, n, place) of the entries that may be the first that a linked pair shares."""
    for b in batches:
        doc, n, alone, blobs = (b.column(i) for i in range(4))
        doc, n, alone = (x.to_numpy().astype(np.int64) for x in (doc, n, alone))
        last = n - _least_overlap(n)
        hs, ds, ns, ps = [], [], [], []
        for i in range(len(doc)):
            h = np.frombuffer(blobs[i].as_py(), "<u8")[: max(0, last[i] - alone[i] + 1)]
            hs.append(h)
            ps.append(alone[i] + np.arange(len(h)))
            ds.append(np.full(len(h), doc[i]))
            ns.append(np.full(len(h), n[i]))
        if hs:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(hs).astype(np.int64)), pa.array(np.concatenate(ds)), pa.array(np.concatenate(ns)), pa.array(np.concatenate(ps))], names=["h", "doc", "n", "p"])


def _possible(a: str, b: str):
    """Bounds on a pair from sizes and from what can still be shared behind the entry."""
    na, nb, pa_, pb = (F.col(x) for x in (f"{a}n", f"{b}n", f"{a}p", f"{b}p"))
    return (4 * F.least(na, nb) >= 3 * F.greatest(na, nb)) & (175 * F.least(na - pa_, nb - pb) >= 75 * (na + nb))


@releasing
def _count_overlaps(batches):
    """Rows sorted by (a, salt, role): a's entries, then partners'; yields the linked pairs."""
    cur, own, size = None, None, 0
    for x in batches:
        a, salt, role, doc, n = (x.column(i).to_pylist() for i in range(5))
        blobs = x.column(5)
        out = []
        for i in range(len(a)):
            h = np.frombuffer(blobs[i].as_py(), "<u8")
            if role[i] == 0:
                cur, own, size = (a[i], salt[i]), np.sort(h), n[i]
                continue
            if cur != (a[i], salt[i]) or not len(own) or not len(h):
                continue
            at = np.minimum(np.searchsorted(own, h), len(own) - 1)
            both = int((own[at] == h).sum())
            if 100 * both >= 75 * (size + n[i] - both):
                out.append((a[i], doc[i]))
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in out], pa.int64()), pa.array([q for _, q in out], pa.int64())], names=["a", "b"])


PAIRS_A_TASK = 256


def _verify(pairs: DataFrame, sets: DataFrame, partitions: int) -> DataFrame:
    """The pairs (a, b) that are linked, by full overlap counts; a's partners are dealt in salted groups."""
    per = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("k"))
    per = per.withColumn("salts", (F.col("k") / PAIRS_A_TASK).cast("int") + 1)
    salted = pairs.join(per, "a").withColumn("salt", F.pmod(F.xxhash64("b"), F.col("salts")).cast("int"))
    members = salted.select("a", "salt", F.lit(1).alias("role"), F.col("b").alias("doc")).join(sets.withColumnRenamed("doc_id", "doc"), "doc").select("a", "salt", "role", "doc", "n", "shared")
    owners = per.select("a", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt")).withColumn("role", F.lit(0))
    owners = owners.join(sets.withColumnRenamed("doc_id", "a"), "a").select("a", "salt", "role", F.col("a").alias("doc"), "n", "shared")
    both = owners.unionByName(members).repartition(partitions, "a", "salt").sortWithinPartitions("a", "salt", "role")
    return both.mapInArrow(_count_overlaps, "a long, b long")


#: Entries and sets of a row block, and columns of a column block of the product.
BLOCK_ENTRIES, BLOCK_SETS, COLUMNS = 1 << 20, 1024, 2048


def product(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Overlap counts of two lists of sets: products of column blocks, added up."""
    sizes = [np.array([len(x) for x in side], np.int64) for side in (a, b)]
    rows = [np.repeat(np.arange(len(n)), n) for n in sizes]
    out = np.zeros((len(a), len(b)), np.float32)
    if not all(len(r) for r in rows):
        return out
    _, column = np.unique(np.concatenate([*a, *b]), return_inverse=True)
    n = int(column.max()) + 1
    left, right = column[: len(rows[0])], column[len(rows[0]) :]
    # Columns that stand in both, those of nearby rows together.
    both = np.flatnonzero((np.bincount(left, minlength=n) > 0) & (np.bincount(right, minlength=n) > 0))
    first = np.full(n, len(a), np.int64)
    np.minimum.at(first, left, rows[0])
    rank = np.full(n, -1, np.int64)
    rank[both[np.argsort(first[both], kind="stable")]] = np.arange(len(both))
    sides = []
    for r, c in ((rows[0], rank[left]), (rows[1], rank[right])):
        keep = c >= 0
        order = np.argsort(c[keep], kind="stable")
        sides.append((r[keep][order], c[keep][order]))
    for lo in range(0, len(both), COLUMNS):
        dense, own = [], []
        for r, c in sides:
            x = slice(*np.searchsorted(c, [lo, lo + COLUMNS]))
            own.append(np.unique(r[x]))
            m = np.zeros((len(own[-1]), COLUMNS), np.float32)
            m[np.searchsorted(own[-1], r[x]), c[x] - lo] = 1
            dense.append(m)
        out[np.ix_(*own)] += dense[0] @ dense[1].T
    return out


@releasing
def _count_links(batches):
    """Rows of pairs of row blocks (root, lo, hi, side, doc, n, copies, shared), sorted by pair, to (doc, links)."""

    def solve(key, rows):
        low = [r for r in rows if r[0] == key[1]]
        high = [r for r in rows if r[0] != key[1]]
        same = key[1] == key[2]
        if not same and not (low and high):
            return
        other = low if same else high
        sets = lambda rs: [np.frombuffer(r[4], "<u8") for r in rs]
        m = product(sets(low), sets(other))
        na, nb = (np.array([r[2] for r in rs], np.int64) for rs in (low, other))
        ca, cb = (np.array([r[3] for r in rs], np.int64) for rs in (low, other))
        total = na[:, None] + nb[None, :]
        linked = (4 * np.minimum(na[:, None], nb[None, :]) >= 3 * np.maximum(na[:, None], nb[None, :])) & (100 * m >= 75 * (total - m))
        if same:
            np.fill_diagonal(linked, False)
        yield [r[1] for r in low], linked @ cb
        if not same:
            yield [r[1] for r in high], linked.T @ ca

    def batch(parts):
        docs, links = [], []
        for d, x in parts:
            docs += d
            links += x.tolist()
        return pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(links, pa.int64())], names=["doc", "links"])

    cur, rows = None, []
    for b in batches:
        keys = list(zip(*(b.column(i).to_pylist() for i in range(3)), strict=True))
        rest = [b.column(i).to_pylist() for i in range(3, 7)]
        for i, key in enumerate(keys):
            if key != cur:
                if rows:
                    yield batch(solve(cur, rows))
                cur, rows = key, []
            rows.append((rest[0][i], rest[1][i], rest[2][i], rest[3][i], b.column(7)[i].as_py()))
    if rows:
        yield batch(solve(cur, rows))


def _links(sets: DataFrame, comp: DataFrame, copies: DataFrame, partitions: int) -> DataFrame:
    """(doc, links): how many documents each distinct set is linked with, but for its own copies."""
    own = comp.join(sets.select(F.col("doc_id").alias("node"), "n", "shared"), "node").join(copies.withColumnRenamed("rep", "node"), "node")
    size = comp.join(sets.select(F.col("doc_id").alias("node"), "n"), "node").groupBy("root").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("e"))
    blocks = F.greatest(F.ceil(F.col("e") / BLOCK_ENTRIES), F.ceil(F.col("c") / BLOCK_SETS)).cast("int")
    dealt = own.join(size.where("c > 1").select("root", blocks.alias("blocks")), "root").withColumn("side", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    pairs = dealt.withColumn("x", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = pairs.select("root", F.least("side", "x").alias("lo"), F.greatest("side", "x").alias("hi"), "side", "node", "n", "copies", "shared")
    sorted_ = rows.repartition(partitions, "root", "lo", "hi").sortWithinPartitions("root", "lo", "hi")
    return sorted_.mapInArrow(_count_links, "doc long, links long").groupBy("doc").agg(F.sum("links").alias("links"))


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", count: bool = True) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest id reachable by links) and, with count, n_links (how many
    documents it is linked with) of every document."""
    rows, names = keyed(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")))
    found = _join(rows.select(F.col("key").alias("doc_id"), "text"), count)
    if names is None:
        return found
    # Keys become ids again; of a component, the smallest of its members' ids.
    known = named(found.withColumnRenamed("doc_id", "key").withColumnRenamed("component_id", "c"), names)
    least = known.groupBy("c").agg(F.min("doc_id").alias("component_id"))
    return known.join(least, "c").select(found.columns)


def _join(rows: DataFrame, count: bool) -> DataFrame:
    """The join of rows (doc_id, text) with unique ids."""
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    bits = max(4, (2 * parts - 1).bit_length())
    dealt = rows.mapInArrow(_deal_entries(bits), _ROW).repartition(parts, "bucket").sortWithinPartitions("bucket")
    back = dealt.mapInArrow(_count_columns(bits), _ROW).repartition(parts, "bucket").sortWithinPartitions("bucket", "kind")
    table = written(back.mapInArrow(_gather_documents, _DOC))
    # One document for each distinct set stands for its copies.
    hope = table.where(F.col("shared").isNotNull())
    # Tables of a small row for each document at most are written by as many tasks as that takes.
    few = hope.count() // ROWS_A_TASK + 1
    # Written first, so that the join below deals both sides anew and a class of very many copies is split.
    classes = cut(hope.groupBy("f1", "f2", "n").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies")).coalesce(few))
    member = cut(hope.select("doc_id", "f1", "f2", "n").join(classes, ["f1", "f2", "n"]).select("doc_id", "rep").coalesce(few))
    sets = written(hope.join(member.where("doc_id = rep").select("doc_id"), "doc_id", "left_semi").select("doc_id", "n", "alone", "shared"))
    entries = written(sets.select("doc_id", "n", "alone", "shared").mapInArrow(_prefix, "h long, doc long, n long, p long"))
    full = sets.select("doc_id", "n", "shared")
    # Pass one: each member against the smallest of its list; of a document's choices, the smallest.
    star = entries.groupBy("h").agg(F.min(F.struct("doc", "n", "p")).alias("c"), F.count(F.lit(1)).alias("k")).where("k > 1")
    star = star.select("h", F.col("c.doc").alias("a"), F.col("c.n").alias("an"), F.col("c.p").alias("ap"))
    first = entries.select("h", F.col("doc").alias("b"), F.col("n").alias("bn"), F.col("p").alias("bp")).join(star, "h").where((F.col("a") != F.col("b")) & _possible("a", "b"))
    tried = cut(first.groupBy("b").agg(F.min("a").alias("a")).select("a", "b").coalesce(few))
    links = cut(_verify(tried, full, parts))
    comp = components(links)
    # Pass two: pairs of a list in different components, each once, but for those counted already.
    marked = entries.join(comp.withColumnRenamed("node", "doc"), "doc", "left").select("h", "doc", "n", "p", F.coalesce("root", "doc").alias("r"))
    mixed = marked.groupBy("h").agg(F.min("r").alias("r1"), F.max("r").alias("r2")).where("r1 < r2").select("h")
    marked = cut(marked.join(mixed, "h", "left_semi"))
    left = marked.select("h", *[F.col(x).alias(f"a{y}") for x, y in (("doc", ""), ("n", "n"), ("p", "p"), ("r", "r"))])
    right = marked.select("h", *[F.col(x).alias(f"b{y}") for x, y in (("doc", ""), ("n", "n"), ("p", "p"), ("r", "r"))])
    rest = left.join(right, "h").where((F.col("a") < F.col("b")) & (F.col("ar") != F.col("br")) & _possible("a", "b")).select("a", "b").distinct()
    rest = cut(rest.join(tried, ["a", "b"], "left_anti"))
    links = links.unionByName(_verify(rest, full, parts))
    comp = components(links)
    # Roots are smallest representatives, and a representative is the smallest of its copies.
    whole = member.join(comp.withColumnRenamed("node", "rep"), "rep", "left").select("doc_id", "rep", F.coalesce("root", "rep").alias("component_id"))
    out = table.select("doc_id", F.col("n").alias("n_shingles"))
    if not count:
        return out.join(whole.drop("rep"), "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    copies = classes.select("rep", "copies")
    links_of = _links(full, comp, copies, parts)
    per = copies.join(links_of.withColumnRenamed("doc", "rep"), "rep", "left").select("rep", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    counted = out.join(whole.join(cut(per.coalesce(few)), "rep"), "doc_id", "left")
    return counted.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def query(spark, sf_dir: str) -> DataFrame:
    from .textblocks import read_table

    return join(read_table(spark, sf_dir, "documents"))


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents
), sh AS (
  SELECT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) END) AS s
  FROM w
), n AS (
  SELECT doc_id, count(s) AS n FROM w LEFT JOIN sh USING (doc_id) GROUP BY doc_id
), p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b USING (s) WHERE a.doc_id <> b.doc_id GROUP BY ALL
), l AS (
  SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)
), r(a, b) AS (
  SELECT doc_id, doc_id FROM n
  UNION
  SELECT r.a, l.b FROM r JOIN l ON l.a = r.b
)
SELECT n.doc_id, n.n AS n_shingles, min(b) AS component_id, (SELECT count(*) FROM l WHERE l.a = n.doc_id) AS n_links FROM n JOIN r ON r.a = n.doc_id GROUP BY n.doc_id, n.n
"""
