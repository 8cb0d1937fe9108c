"""Operator 5: removal of long repeated byte strings, by merged Burrows-Wheeler transforms.

Every byte that a ``length``-byte string covers goes if that string also starts anywhere else.

1. Anchors.  Among the hashes of the short windows inside a ``length``-byte string, the smallest
   (leftmost on ties) is its anchor.  Equal strings have equal anchors, so a string whose anchor
   hash occurs once in the corpus cannot repeat.  One row for each anchor, not for each byte, is
   shuffled.  Stretches of a short period repeat inside one document: they are marked there, and one
   period stands for them.
2. Contexts.  Where an anchor hash repeats, the bytes of the strings that it anchors are dealt by
   that hash, hot hashes in salted groups.
3. Shards.  Contexts form shards.  A shard's suffixes are sorted once into a Burrows-Wheeler
   transform over symbols of many bytes.  Shards that share an anchor hash are merged by
   iterative interleave refinement: an interleave bit for each suffix, sorted stably by the
   preceding symbol until ``length`` bytes are compared; no suffix is sorted again.  Where two
   neighbours part gives their common prefix; runs that don't part within ``length`` bytes are the
   repeated intervals.
4. Salted groups of one hash hand on one hash for each string that they saw, which decides strings
   that repeat across groups only.
5. Passages.  Beside the removal, each document's number of anchors of ``PASSAGE``-byte strings that
   another document holds too: above nought wherever it shares so many consecutive bytes.

A symbol has the largest number of bytes up to ``SYMBOL`` that divides ``length``.

Null text is empty.  Texts shorter than ``length`` bytes lose nothing.  Every row is a document of its
own, with its id as it is, null and repeated ids included.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .keys import keyed, named
from .lineage import written
from .textblocks import blocks, mix, prefix_sums, span_hashes

GRAM = 32
SYMBOL, LEAST_SYMBOL = 100, 8
PASSAGE, PASSAGE_GRAM = 256, 64
SHARD_BYTES = 1 << 19
GROUP_ROWS = 2000


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w consecutive values, by block prefixes and suffixes."""
    n = len(x)
    rows = -(-n // w)
    pad = np.full(rows * w, np.iinfo(np.uint64).max, np.uint64)
    pad[:n] = x
    grid = pad.reshape(rows, w)
    pre = np.minimum.accumulate(grid, axis=1).ravel()
    suf = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(suf[: n - w + 1], pre[w - 1 : n])


def symbol_bytes(length: int) -> int:
    """Bytes of a symbol for strings of some length."""
    for n in range(min(SYMBOL, length), LEAST_SYMBOL - 1, -1):
        if length % n == 0:
            return n
    raise ValueError(f"length has no divisor from {LEAST_SYMBOL} to {SYMBOL}")


def passage_grams(h: np.ndarray, offs: np.ndarray):
    """Distinct (row, hash): the smallest hash among the gram windows of every PASSAGE-byte string.

    h: the hashes of all GRAM-byte windows; a passage's gram is two of them side by side.
    """
    none = np.zeros(0, np.int64), np.zeros(0, np.uint64)
    if len(h) <= PASSAGE - GRAM:
        return none
    two = mix(h[:-GRAM] * np.uint64(0x9E3779B97F4A7C15) + h[GRAM:])
    best = _sliding_min(two, PASSAGE - PASSAGE_GRAM + 1)
    new = np.ones(len(best), bool)
    new[1:] = best[1:] != best[:-1]
    new[offs[:-1][offs[:-1] < len(best)]] = True
    at = np.flatnonzero(new)
    row = np.searchsorted(offs, at, "right") - 1
    inside = at + PASSAGE <= offs[row + 1]
    row, best = row[inside], best[at[inside]]
    order = np.lexsort((best, row))
    row, best = row[order], best[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (best[1:] != best[:-1])
    return row[new], best[new]


def gram_hashes(data: np.ndarray, p: np.ndarray) -> np.ndarray:
    at = np.arange(max(0, len(data) - GRAM + 1))
    return span_hashes(p, at, at + GRAM)


def anchors(data: np.ndarray, offs: np.ndarray, length: int, p: np.ndarray, h: np.ndarray):
    """Of a block: (row, anchor hash, first and last start that it anchors, last marked start, dropped)."""
    none = np.zeros(0, np.int64)
    sizes = offs[1:] - offs[:-1]
    if len(data) < length or sizes.max(initial=0) < length:
        return none, none.astype(np.uint64), none, none, none, none.astype(bool)
    bits = max(20, int(len(data)).bit_length())
    low = np.uint64((1 << bits) - 1)
    best = _sliding_min((h & ~low) | np.arange(len(h), dtype=np.uint64), length - GRAM + 1)
    new = np.ones(len(best), bool)
    new[1:] = best[1:] != best[:-1]
    new[offs[:-1][offs[:-1] < len(best)]] = True
    s1 = np.flatnonzero(new)
    s2 = np.append(s1[1:], len(best)) - 1
    row = np.searchsorted(offs, s1, "right") - 1
    whole_strings = s1 + length <= offs[row + 1]
    s1, s2, row = s1[whole_strings], np.minimum(s2, offs[row + 1] - length)[whole_strings], row[whole_strings]
    f = h[(best[s1] & low).astype(np.int64)]
    # A run of anchors that equals the run before it, string by string, is a period.
    n = s2 - s1 + 1
    whole = lambda s: span_hashes(p, s, s + length)
    equal = np.zeros(len(s1), bool)
    j = np.flatnonzero((f[1:] == f[:-1]) & (row[1:] == row[:-1]) & (s1[1:] == s2[:-1] + 1) & (n[1:] <= n[:-1])) + 1
    if len(j):
        back = n[j - 1]
        equal[j] = (whole(s1[j]) == whole(s1[j] - back)) & (whole(s2[j]) == whole(s2[j] - back))
    # Marked: the equal run, and as many first strings of the run before it.
    many = np.where(equal, n, 0)
    many[:-1] = np.maximum(many[:-1], many[1:])
    return row, f, s1 - offs[row], s2 - offs[row], s1 - offs[row] + many - 1, equal


SEEN, MARK, SHARED = 0, 1, 2
_ANCHOR = "f long, doc long, s1 long, s2 long, kind int"


def _anchor_rows(length: int):
    """Texts to their anchors (SEEN), the periods marked inside (MARK) and passage anchors (SHARED)."""

    def run(batches):
        for b in batches:
            keys = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for lo, hi, data, offs in blocks(b.column(1)):
                p = prefix_sums(data)
                h = gram_hashes(data, p)
                row, f, s1, s2, until, drop = anchors(data, offs, length, p, h)
                doc = keys[lo:hi][row]
                parts = [(f[x], doc[x], s1[x], last[x], kind) for x, last, kind in ((~drop, s2, SEEN), (until >= s1, until, MARK))]
                row, f = passage_grams(h, offs)
                parts.append((f, keys[lo:hi][row], np.zeros(len(f), np.int64), np.zeros(len(f), np.int64), SHARED))
                for f, doc, first, last, kind in parts:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(f.view(np.int64)), pa.array(doc), pa.array(first), pa.array(last), pa.array(np.full(len(f), kind, np.int32))],
                        names=["f", "doc", "s1", "s2", "kind"],
                    )

    return run


_CONTEXT = "f long, salt int, doc long, s1 long, s2 long, ctx binary"


def _context_rows(length: int):
    """Joined rows (text, anchors of one document) to the bytes of the strings of each anchor."""

    def run(batches):
        for b in batches:
            docs = b.column(0).to_pylist()
            lists = b.column(2)
            out = []
            for i, doc in enumerate(docs):
                raw = (b.column(1)[i].as_py() or "").encode()
                for x in lists[i].as_py():
                    out.append((x["f"], x["salt"], doc, x["s1"], x["s2"], raw[x["s1"] : x["s2"] + length]))
                if len(out) > 4000:
                    yield _contexts(out)
                    out = []
            yield _contexts(out)

    return run


def _contexts(out):
    cols = list(zip(*out, strict=True)) if out else [[]] * 6
    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, kinds, strict=True)], names=[c.split()[0] for c in _CONTEXT.split(", ")])


def _order(x: np.ndarray) -> np.ndarray:
    """The stable order of hashes: their upper bits are sorted with the place below them, and only
    where these don't tell two hashes apart all bits are."""
    bits = max(1, (len(x) - 1).bit_length())
    low = np.uint64((1 << bits) - 1)
    packed = np.sort((x & ~low) | np.arange(len(x), dtype=np.uint64))
    order = (packed & low).astype(np.int64)
    own = x[order]
    if ((packed[1:] ^ packed[:-1] <= low) & (own[1:] != own[:-1])).any():
        return np.argsort(x, kind="stable")
    return order


class Shard:
    """Suffixes of some contexts, sorted by their first ``depth`` symbols, with their transform.

    order: suffix numbers (context, place) packed by the caller; bwt: the symbol before each suffix
    (0: none); short: suffixes without a symbol of their own, which stand first.
    """

    def __init__(self, order, bwt, short):
        self.order, self.bwt, self.short = order, bwt, short

    @classmethod
    def build(cls, text: np.ndarray, offs: np.ndarray, depth: int, first: int, symbol: int) -> Shard:
        """Sorts one shard: depth stable sorts by preceding symbol, from the unsorted suffixes on.

        A context holds strings of depth symbols that start at its first places, up to its end, and one
        byte that is no part of it: the last string's empty rest stands there.  Only suffixes that a
        string is compared at take part: those at its start and every symbol on.
        """
        sizes = offs[1:] - offs[:-1]
        place = np.arange(len(text)) - np.repeat(offs[:-1], sizes)
        many = np.repeat(sizes - depth * symbol, sizes)  # strings of the place's context
        has = np.zeros(len(text), bool)
        for k in range(depth):
            has |= (place >= k * symbol) & (place < k * symbol + many)
        at = np.flatnonzero(has)
        sym = np.zeros(len(text), np.uint64)
        sym[at] = span_hashes(prefix_sums(text), at, at + symbol) | np.uint64(1)
        short = np.flatnonzero((place >= depth * symbol) & ~has)
        order = np.concatenate([short, at])
        for _ in range(depth):
            prev = order[place[order] >= symbol] - symbol
            order = np.concatenate([short, prev[_order(sym[prev])]])
        bwt = np.where(place[order] >= symbol, sym[np.maximum(order - symbol, 0)], np.uint64(0))
        return cls(order + first, bwt, len(short))


def merge(a: Shard, b: Shard, depth: int) -> Shard:
    """One shard of both, by interleave refinement: only bits move, no suffix is compared again."""
    ends = np.concatenate([np.zeros(a.short, bool), np.ones(b.short, bool)])
    z = np.concatenate([ends, np.zeros(len(a.order) - a.short, bool), np.ones(len(b.order) - b.short, bool)])
    for _ in range(depth):
        sym = _interleaved(z, a.bwt, b.bwt)
        keep = sym != 0
        new = np.concatenate([ends, z[keep][_order(sym[keep])]])
        if np.array_equal(new, z):
            break
        z = new
    return Shard(_interleaved(z, a.order, b.order), _interleaved(z, a.bwt, b.bwt), a.short + b.short)


def _interleaved(z, x, y):
    out = np.empty(len(z), x.dtype)
    out[~z], out[z] = x, y
    return out


def repeated(shard: Shard, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffix numbers in order, and the class of each: equal classes share depth symbols.

    Classes are refined through the transform alone: a suffix's class at depth k + 1 is its first
    symbol with the class at depth k of the suffix behind it.  -1: shorter than depth symbols.
    """
    n = len(shard.order)
    linked = np.flatnonzero(shard.bwt != 0)
    perm = linked[_order(shard.bwt[linked])]
    # The k-th suffix that starts with a symbol stands before the k-th occurrence of it.
    target = shard.short + np.arange(len(perm))
    cls = np.zeros(n, np.int64)
    for _ in range(depth):
        c = cls[perm]
        live = c >= 0
        s, c, t = shard.bwt[perm[live]], c[live], target[live]
        part = np.ones(len(s), bool)
        part[1:] = (s[1:] != s[:-1]) | (c[1:] != c[:-1])
        cls = np.full(n, -1, np.int64)
        cls[t] = np.cumsum(part) - 1
    return shard.order, cls


_MARK = "doc long, a long, b long, h long, many boolean"


def _mark_rows(length: int):
    """Contexts sorted by (f, salt) to marks: [a, b) ranges that repeat, and for salted groups hashes."""
    symbol = symbol_bytes(length)
    depth = length // symbol

    def solve(rows):
        """Contexts that hold every occurrence within their (f, salt) groups."""
        # Equal contexts: all their strings repeat; one of them stands for the rest below.
        first: dict[bytes, int] = {}
        stands = np.array([first.setdefault(r[5], i) for i, r in enumerate(rows)])
        copies = np.bincount(stands, minlength=len(rows)) > 1
        docs = np.array([r[2] for r in rows], dtype=np.int64)
        s1, s2 = np.array([r[3] for r in rows]), np.array([r[4] for r in rows])
        alike = copies[stands]
        if alike.any():
            yield batch(docs[alike], s1[alike], s2[alike] + length)
        salted = np.array([r[1] >= 0 for r in rows])
        only = np.flatnonzero(stands == np.arange(len(rows)))
        # Strings of one context differ, and equal ones share a group: a context alone in its group is done.
        group = np.cumsum([i == 0 or rows[i][:2] != rows[i - 1][:2] for i in range(len(rows))])[only]
        only = only[(np.bincount(group)[group] > 1) | salted[only]]
        if not len(only):
            return
        texts = [rows[i][5] + b"\0" for i in only.tolist()]
        sizes = np.array([len(t) for t in texts])
        total = np.concatenate([[0], np.cumsum(sizes)])
        shards, lo, at = [], 0, 0
        while lo < len(texts):
            hi = max(lo + 1, int(np.searchsorted(total, total[lo] + SHARD_BYTES, "right")) - 1)
            text = np.frombuffer(b"".join(texts[lo:hi]), np.uint8)
            shards.append(Shard.build(text, total[lo : hi + 1] - total[lo], depth, at, symbol))
            at += len(text)
            lo = hi
        while len(shards) > 1:
            shards = [merge(*shards[i : i + 2], depth) if i + 1 < len(shards) else shards[i] for i in range(0, len(shards), 2)]
        order, cls = repeated(shards[0], depth)
        ctx = np.searchsorted(total, order, "right") - 1
        place = order - total[ctx]
        ctx = only[ctx]
        own = (cls >= 0) & (place <= s2[ctx] - s1[ctx])
        order, cls, ctx, place = order[own], cls[own], ctx[own], place[own]
        many = np.bincount(cls)[cls] > 1 if len(cls) else np.zeros(0, bool)
        start = s1[ctx] + place
        yield from ranges(docs[ctx[many]], start[many])
        across = salted[ctx]
        if across.any():
            text = np.frombuffer(b"".join(texts), np.uint8)
            idx = np.flatnonzero(across)
            _, one = np.unique(cls[idx], return_index=True)
            idx = idx[one]  # a string's hash once for each group of rows
            o = order[idx]
            h = span_hashes(prefix_sums(text), o, o + length)
            yield batch(docs[ctx[idx]], start[idx], start[idx] + length, h.view(np.int64), many[idx])

    def batch(doc, a, b, h=None, many=None):
        n = len(doc)
        return pa.RecordBatch.from_arrays(
            [pa.array(doc), pa.array(a), pa.array(b), pa.array(h, pa.int64()) if h is not None else pa.nulls(n, pa.int64()), pa.array(many) if many is not None else pa.array(np.ones(n, bool))],
            names=["doc", "a", "b", "h", "many"],
        )

    def ranges(doc, start):
        if len(doc):
            order = np.lexsort((start, doc))
            doc, start = doc[order], start[order]
            new = np.ones(len(doc), bool)
            new[1:] = (doc[1:] != doc[:-1]) | (start[1:] > start[:-1] + length)
            k = np.flatnonzero(new)
            yield batch(doc[k], start[k], start[np.append(k[1:], len(doc)) - 1] + length)

    def run(batches):
        rows, size, cur = [], 0, None
        for b in batches:
            cols = [b.column(i).to_pylist() for i in range(6)]
            for r in zip(*cols, strict=True):
                if (r[0], r[1]) != cur:
                    if size >= 2 * SHARD_BYTES:
                        yield from solve(rows)
                        rows, size = [], 0
                    cur = (r[0], r[1])
                rows.append(r)
                size += len(r[5])
        if rows:
            yield from solve(rows)

    return run


_OUT = "key long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_shared_passages long, kept_text string"


def _cut_rows(length: int, with_text: bool, keep: list[str]):
    """Rows (key, text, spans, shared, kept columns) to their result."""

    def run(batches):
        for b in batches:
            lists, shared = b.column(2).to_pylist(), b.column(3).to_pylist()
            out = []
            for i, spans in enumerate(lists):
                raw = (b.column(1)[i].as_py() or "").encode()
                merged = []
                for s in sorted((x["a"], x["b"]) for x in spans or []):
                    if merged and s[0] <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], s[1])
                    else:
                        merged.append([*s])
                kept, at = [], 0
                for x, y in merged:
                    kept.append(raw[at:x])
                    at = y
                kept = b"".join([*kept, raw[at:]])
                # A range may begin or end inside a character; what is left of one isn't text.
                text = kept.decode(errors="ignore") if with_text else None
                out.append((len(raw), sum(y - x for x, y in merged), len(merged), hashlib.sha256(kept).hexdigest(), shared[i] or 0, text))
            cols = list(zip(*out, strict=True)) if out else [[]] * 6
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string())
            rest = [b.column(i) for i in range(4, b.num_columns)]
            names = [c.split()[0] for c in _OUT.split(", ")] + keep
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), *[pa.array(x, t) for x, t in zip(cols, kinds, strict=True)], *rest], names=names)

    return run


def repeated_ranges(docs: DataFrame, length: int = 400) -> DataFrame:
    """(doc, spans, shared): of documents (key, text) the [a, b) byte ranges to remove, and how many
    passage anchors another document holds too."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = written(docs.mapInArrow(_anchor_rows(length), _ANCHOR), "kind")
    seen = found.where(F.col("kind") == SEEN).select("f", "doc", "s1", "s2")
    # Partial counts first, so a hot hash costs one row a task.
    often = seen.groupBy("f").agg(F.count(F.lit(1)).alias("k")).where("k > 1")
    hot = F.col("k") > 2 * GROUP_ROWS
    salt = F.when(hot, F.pmod(F.xxhash64("doc", "s1"), (F.col("k") / GROUP_ROWS).cast("int") + 1)).otherwise(-1).cast("int")
    some = seen.join(often, "f").select("doc", F.struct("f", salt.alias("salt"), "s1", "s2").alias("x"))
    lists = some.groupBy("doc").agg(F.collect_list("x").alias("xs"))
    texts = docs.repartition(parts, "key")
    both = texts.join(lists, texts["key"] == lists["doc"]).select("key", "text", "xs")
    ctx = both.mapInArrow(_context_rows(length), _CONTEXT).repartition(parts, "f", "salt").sortWithinPartitions("f", "salt")
    marks = written(ctx.mapInArrow(_mark_rows(length), _MARK))
    across = marks.where(F.col("h").isNotNull())
    again = across.groupBy("h").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("h")
    more = across.join(again, "h", "left_semi").select("doc", "a", "b")
    local = found.where(F.col("kind") == MARK).select("doc", F.col("s1").alias("a"), (F.col("s2") + length).alias("b"))
    every = marks.where(F.col("h").isNull()).select("doc", "a", "b").unionByName(more).unionByName(local)
    grams = found.where(F.col("kind") == SHARED).select("f", "doc")
    twice = grams.groupBy("f").agg(F.min("doc").alias("x"), F.max("doc").alias("y")).where("x < y").select("f")
    shared = grams.join(twice, "f", "left_semi").groupBy("doc").agg(F.count(F.lit(1)).alias("n"))
    nothing = F.lit(None).cast("long")
    rows = every.select("doc", "a", "b", nothing.alias("n")).unionByName(shared.select("doc", nothing.alias("a"), nothing.alias("b"), "n"))
    span = F.when(F.col("a").isNotNull(), F.struct("a", "b"))
    return rows.groupBy("doc").agg(F.collect_list(span).alias("spans"), F.max("n").alias("shared"))


def dedup(docs: DataFrame, length: int = 400, id_col: str = "doc_id", text_col: str = "text", with_text: bool = True, keep: list[str] | None = None) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_shared_passages, (with_text) kept_text, and columns in keep."""
    keep = keep or []
    symbol_bytes(length)
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *[F.col(c).alias(f"k_{c}") for c in keep])
    rows, names = keyed(rows)
    spans = repeated_ranges(rows.select("key", "text"), length)
    texts = rows.drop("doc_id").repartition(parts, "key")
    joined = texts.join(spans, texts["key"] == spans["doc"], "left").select("key", "text", "spans", "shared", *[f"k_{c}" for c in keep])
    kept = "".join(f", `{c}` {rows.schema[f'k_{c}'].dataType.simpleString()}" for c in keep)
    out = named(joined.mapInArrow(_cut_rows(length, with_text, keep), _OUT + kept), names)
    return out if with_text else out.drop("kept_text")


def query(spark, sf_dir: str) -> DataFrame:
    from .textblocks import read_table

    return dedup(read_table(spark, sf_dir, "documents"), with_text=False)
