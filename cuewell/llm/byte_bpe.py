"""Operator 9: byte-level BPE encoding and decoding, vectorised.

Pre-tokenisation uses no regex.  Code points map to character classes through an array; a small
automaton over those classes marks token starts.  Each class is a transition function on the
automaton's states; functions compose associatively, so a prefix scan over the functions (blocked,
all blocks side by side) gives the state at every code point at once.  Token slices are hashed,
made unique per block, and merged once per distinct slice with a bounded cache; ids and byte
offsets spread back by array takes, and decoding is an array take too.

Null or empty text: no tokens.  Rows are independent: ties, repeats and extra columns need no care.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import heapq
import unicodedata

import numpy as np
import pyarrow as pa

from .textblocks import blocks, prefix_sums, ragged_take, span_hashes

# Character classes after look-ahead.
LETTER, NUMBER, OTHER, QUOTE1, QUOTE2, SPACE_IN, SPACE_LAST, WHITE_LAST = range(8)
#   QUOTE1/QUOTE2: an apostrophe that a contraction of one/two letters follows
#   SPACE_IN: white space that white space or the text's end follows
#   SPACE_LAST: U+0020 before a visible character; WHITE_LAST: other white space before one
# States: what the code point just read belongs to.
S_TEXT, S_LETTER, S_NUMBER, S_OTHER, S_PREFIX, S_WHITE, S_WLAST, S_C1, S_C2, S_CEND = range(10)
N_STATES = 10
CACHE_SLICES = 500_000


def _step(state: int, cls: int) -> tuple[int, bool]:
    """Next state, and whether a token starts at this code point."""
    if state == S_C1:
        return S_CEND, False
    if state == S_C2:
        return S_C1, False
    fresh = state in (S_TEXT, S_CEND, S_WHITE, S_WLAST)
    if cls == LETTER:
        return S_LETTER, state not in (S_LETTER, S_PREFIX)
    if cls == NUMBER:
        return S_NUMBER, state not in (S_NUMBER, S_PREFIX)
    if cls in (OTHER, QUOTE1, QUOTE2):
        if state in (S_OTHER, S_PREFIX):
            return S_OTHER, False
        if cls == OTHER:
            return S_OTHER, True
        return (S_C1 if cls == QUOTE1 else S_C2), True
    if cls == SPACE_IN:
        return S_WHITE, not (fresh and state == S_WHITE)
    return (S_PREFIX if cls == SPACE_LAST else S_WLAST), True


@functools.cache
def _automaton():
    """The monoid of transition functions: composition table, elements of classes, outputs.

    Class c acts as a function on states.  At a text's first code point the function is constant:
    it is the class function applied to the start state, whatever came before.
    """
    gens = [tuple(_step(s, c)[0] for s in range(N_STATES)) for c in range(8)]
    first = [(_step(S_TEXT, c)[0],) * N_STATES for c in range(8)]
    order = [tuple(range(N_STATES))]
    elems = {order[0]: 0}
    for f in order:  # grows while it is read
        for g in gens + first:
            h = tuple(g[x] for x in f)
            if h not in elems:
                elems[h] = len(order)
                order.append(h)
    m = len(order)
    comp = np.array([[elems[tuple(fb[x] for x in fa)] for fb in order] for fa in order], dtype=np.int16)
    from_text = np.array([f[S_TEXT] for f in order], dtype=np.int8)
    starts = np.array([[_step(s, c)[1] for c in range(8)] for s in range(N_STATES)])
    cls_elem = np.array([elems[g] for g in gens], dtype=np.int16)
    first_elem = np.array([elems[g] for g in first], dtype=np.int16)
    return comp.ravel(), m, cls_elem, first_elem, from_text, starts


def _scan(elems: np.ndarray) -> np.ndarray:
    """Inclusive prefix composition; blocks advance side by side, then take their block's prefix."""
    comp, m, *_ = _automaton()
    n, width = len(elems), 64
    if n <= width:
        out = elems.copy()
        for i in range(1, n):
            out[i] = comp[int(out[i - 1]) * m + int(out[i])]
        return out
    rows = -(-n // width)
    grid = np.zeros(rows * width, dtype=np.int16)
    grid[:n] = elems
    grid = np.ascontiguousarray(grid.reshape(rows, width).T)
    for j in range(1, width):
        grid[j] = comp[grid[j - 1].astype(np.int32) * m + grid[j]]
    totals = _scan(grid[-1])
    before = np.zeros(rows, dtype=np.int32)
    before[1:] = totals[:-1]
    grid = comp[before[None, :] * m + grid]
    return grid.T.ravel()[:n]


@functools.cache
def _class_array() -> np.ndarray:
    """Class of every code point before look-ahead: letter, number, other, or white space."""
    out = np.full(0x110000, OTHER, dtype=np.uint8)
    for cp in range(0x110000):
        cat = unicodedata.category(chr(cp))
        if cat[0] == "L":
            out[cp] = LETTER
        elif cat[0] == "N":
            out[cp] = NUMBER
    # The code points that Unicode calls white space.
    white = [*range(0x9, 0xE), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
    out[white] = SPACE_IN
    return out


def _codepoints(data: np.ndarray):
    """Code points of UTF-8 bytes and the byte where each starts."""
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    b = data[lead].astype(np.uint32)
    cp = b.copy()
    if (b >= 0x80).any():
        pad = np.concatenate([data, np.zeros(3, np.uint8)]).astype(np.uint32) & 0x3F
        for lo, hi, bits, n in ((0xC0, 0xE0, 0x1F, 1), (0xE0, 0xF0, 0x0F, 2), (0xF0, 0x100, 0x07, 3)):
            at = np.flatnonzero((b >= lo) & (b < hi))
            v = b[at] & bits
            for k in range(1, n + 1):
                v = (v << 6) | pad[lead[at] + k]
            cp[at] = v
    return cp, lead


def token_spans(data: np.ndarray, offs: np.ndarray):
    """Byte starts and ends of all pre-tokens of a block; rows are separate texts."""
    if len(data) == 0:
        z = np.zeros(0, np.int64)
        return z, z
    cp, lead = _codepoints(data)
    n = len(cp)
    cls = _class_array()[cp]
    new_text = np.zeros(n + 1, dtype=bool)
    new_text[np.searchsorted(lead, offs[:-1][offs[:-1] < offs[1:]])] = True
    new_text[n] = True
    ends = new_text[1:]  # the code point is its text's last
    white = cls == SPACE_IN
    visible_next = np.zeros(n, dtype=bool)
    visible_next[:-1] = ~white[1:] & ~ends[:-1]
    last = white & visible_next
    cls[last & (cp == 32)] = SPACE_LAST
    cls[last & (cp != 32)] = WHITE_LAST
    quote = np.flatnonzero(cp == 39)
    if len(quote):
        padded = np.concatenate([cp, np.zeros(2, np.uint32)])
        end2 = np.concatenate([ends, [True, True]])
        one, two = padded[quote + 1], padded[quote + 2]
        in1 = ~end2[quote]
        in2 = in1 & ~end2[quote + 1]
        single = in1 & np.isin(one, [ord(c) for c in "stmd"])
        pairs = [("r", "e"), ("v", "e"), ("l", "l")]
        double = in2 & np.logical_or.reduce([(one == ord(a)) & (two == ord(b)) for a, b in pairs])
        cls[quote[single]] = QUOTE1
        cls[quote[double]] = QUOTE2
    _, _, cls_elem, first_elem, from_text, starts = _automaton()
    elems = cls_elem[cls]
    first = np.flatnonzero(new_text[:n])
    elems[first] = first_elem[cls[first]]
    state = from_text[_scan(elems)]
    before = np.empty(n, dtype=np.int8)
    before[1:] = state[:-1]
    before[first] = S_TEXT
    at = lead[np.flatnonzero(starts[before, cls])]
    return at, np.append(at[1:], len(data))


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class PairTable:
    """Which neighbouring ids join, and into which id; a lower id joins earlier."""

    NONE = np.int32(2**31 - 1)

    def __init__(self, byte_ids: np.ndarray, pairs: dict[tuple[int, int], int]):
        self.byte_ids = byte_ids.astype(np.int32)
        self.pairs = pairs
        keys = np.array([(a << 32) | b for a, b in pairs], dtype=np.int64)
        order = np.argsort(keys)
        self.keys = keys[order]
        self.ids = np.array(list(pairs.values()), dtype=np.int32)[order]
        low = np.full((256, 256), self.NONE, dtype=np.int32)
        back = {int(i): b for b, i in enumerate(byte_ids)}
        for (x, y), i in pairs.items():
            if x in back and y in back:
                low[back[x], back[y]] = i
        self.of_bytes = low

    @classmethod
    def from_ranks(cls, ranks: dict[bytes, int]) -> PairTable:
        pairs = {}
        for t, i in ranks.items():
            for k in range(1, len(t)):
                if (x := ranks.get(t[:k])) is not None and (y := ranks.get(t[k:])) is not None:
                    pairs[x, y] = i
        return cls(np.array([ranks[bytes([b])] for b in range(256)]), pairs)

    def join(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        key = (x.astype(np.int64) << 32) | y
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ids[at], self.NONE)

    def merge_many(self, data: np.ndarray, starts: np.ndarray, lens: np.ndarray):
        """Ids of many slices at once: (flat ids, offsets).  All slices take a merge step together."""
        out: list = [None] * len(starts)
        sizes = np.zeros(len(starts) + 1, np.int64)
        short = np.flatnonzero(lens <= 48)
        for k in np.flatnonzero(lens > 48).tolist():
            raw = data[starts[k] : starts[k] + lens[k]]
            out[k] = np.array(_merge_long(self.byte_ids[raw].tolist(), self.pairs), dtype=np.uint32)
            sizes[k + 1] = len(out[k])
        done = []
        for lo, hi in ((1, 4), (5, 8), (9, 16), (17, 48)):
            rows = short[(lens[short] >= lo) & (lens[short] <= hi)]
            if len(rows):
                done.append((rows, *self._steps(data, starts[rows], lens[rows], hi)))
        for rows, _, n in done:
            sizes[rows + 1] = n
        offs = np.cumsum(sizes)
        flat = np.empty(offs[-1], np.uint32)
        for rows, grid, n in done:
            keep = np.arange(grid.shape[1])[None, :] < n[:, None]
            flat[(offs[rows][:, None] + np.arange(grid.shape[1]))[keep]] = grid[keep]
        for k, ids in enumerate(out):
            if ids is not None:
                flat[offs[k] : offs[k + 1]] = ids
        return flat, offs

    def _steps(self, data, starts, lens, width):
        cols = np.arange(width)
        inside = cols[None, :] < lens[:, None]
        raw = data[np.where(inside, starts[:, None] + cols, 0)]
        grid = self.byte_ids[raw]
        rank = np.full((len(starts), width), self.NONE, dtype=np.int32)
        rank[:, :-1] = np.where(inside[:, 1:], self.of_bytes[raw[:, :-1], raw[:, 1:]], self.NONE)
        n = lens.copy()
        result = grid.copy()
        live = np.arange(len(starts))
        while len(live):
            at = rank.argmin(axis=1)
            low = rank[np.arange(len(live)), at]
            stop = low == self.NONE
            if stop.any():
                result[live[stop]] = grid[stop]
                go = ~stop
                live, grid, rank, at, low = live[go], grid[go], rank[go], at[go], low[go]
                if not len(live):
                    break
            i = np.arange(len(live))
            n[live] -= 1
            src = np.minimum(cols[None, :] + (cols[None, :] > at[:, None]), width - 1)
            grid = np.take_along_axis(grid, src, axis=1)
            src = np.minimum(cols[None, :] + (cols[None, :] >= at[:, None]), width - 1)
            rank = np.take_along_axis(rank, src, axis=1)
            rank[:, -1] = self.NONE
            grid[i, at] = low
            left = np.flatnonzero(at > 0)
            rank[left, at[left] - 1] = self.join(grid[left, at[left] - 1], low[left])
            right = np.flatnonzero(at + 1 < n[live])
            rank[i, at] = self.NONE
            rank[right, at[right]] = self.join(low[right], grid[right, at[right] + 1])
        return result, n


def _merge_long(ids: list[int], pairs: dict[tuple[int, int], int]) -> list[int]:
    """The same merges on one long slice, by a heap over linked parts: near-linear time."""
    n = len(ids)
    prev, nxt = list(range(-1, n - 1)), list(range(1, n + 1))
    alive = [True] * n
    heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := pairs.get((ids[i], ids[i + 1]))) is not None]
    heapq.heapify(heap)
    while heap:
        r, i, x, y = heapq.heappop(heap)
        if not alive[i] or ids[i] != x or (j := nxt[i]) >= n or ids[j] != y:
            continue
        alive[j] = False
        ids[i], nxt[i] = r, nxt[j]
        if (q := nxt[i]) < n:
            prev[q] = i
            if (s := pairs.get((r, ids[q]))) is not None:
                heapq.heappush(heap, (s, i, r, ids[q]))
        if (k := prev[i]) >= 0 and (s := pairs.get((ids[k], r))) is not None:
            heapq.heappush(heap, (s, k, ids[k], r))
    return [ids[i] for i in range(n) if alive[i]]


class Encoder:
    """Encodes and decodes blocks of texts; slices met before come from a bounded cache."""

    def __init__(self, pairs: PairTable, token_bytes: list[bytes]):
        self.pairs = pairs
        self.vocab_offs = np.zeros(len(token_bytes) + 1, np.int64)
        np.cumsum([len(t) for t in token_bytes], out=self.vocab_offs[1:])
        self.vocab = np.frombuffer(b"".join(token_bytes), np.uint8)
        self._forget()

    def _forget(self):
        self.keys, self.at = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.flat, self.offs = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    @classmethod
    def from_ranks(cls, path: str) -> Encoder:
        ranks = load_ranks(path)
        table = [b""] * (max(ranks.values()) + 1)
        for t, i in ranks.items():
            table[i] = t
        return cls(PairTable.from_ranks(ranks), table)

    def _runs(self, data, keys, starts, lens):
        """Number of each slice's run in the cache, merging the slices that it lacks."""
        if len(self.keys) > CACHE_SLICES:
            self._forget()
        where = np.searchsorted(self.keys, keys)
        hit = np.zeros(len(keys), bool)
        inside = where < len(self.keys)
        hit[inside] = self.keys[where[inside]] == keys[inside]
        new = np.flatnonzero(~hit)
        if len(new):
            flat, offs = self.pairs.merge_many(data, starts[new], lens[new])
            number = np.arange(len(self.offs) - 1, len(self.offs) - 1 + len(new))
            self.flat = np.concatenate([self.flat, flat])
            self.offs = np.concatenate([self.offs, self.offs[-1] + offs[1:]])
            self.at = np.insert(self.at, where[new], number)
            self.keys = np.insert(self.keys, where[new], keys[new])
            where = np.searchsorted(self.keys, keys)
        return self.at[where]

    def encode(self, data: np.ndarray, offs: np.ndarray):
        """(ids, row offsets into ids, byte start of each id) of a block."""
        starts, ends = token_spans(data, offs)
        keys = span_hashes(prefix_sums(data), starts, ends)
        distinct, first, inverse = np.unique(keys, return_index=True, return_inverse=True)
        runs = self._runs(data, distinct, starts[first], (ends - starts)[first])
        ids, tok_offs = ragged_take(self.flat, self.offs, runs[inverse])
        rows = tok_offs[np.searchsorted(starts, offs, "left")]
        lens = (self.vocab_offs[1:] - self.vocab_offs[:-1])[ids]
        return ids, rows, np.cumsum(lens) - lens

    def decode(self, ids: np.ndarray) -> np.ndarray:
        return ragged_take(self.vocab, self.vocab_offs, ids)[0]


def encode_table(df, ranks_path: str, id_col: str = "doc_id", text_col: str = "text", digests: bool = True):
    """One row per document: its id, n_tokens, and ids (or digests of ids and decoded bytes).

    Partition-wise, no shuffle; memory is bounded by the block size or by the longest text.
    """
    schema = f"{id_col} long, n_tokens long, " + ("ids_sha256 string, decoded_sha256 string" if digests else "ids array<long>, byte_starts array<long>")

    def run(batches):
        enc = Encoder.from_ranks(ranks_path)
        for batch in batches:
            keys = batch.column(0)
            for lo, hi, data, offs in blocks(batch.column(1)):
                ids, rows, at = enc.encode(data, offs)
                n = pa.array(rows[1:] - rows[:-1], pa.int64())
                if digests:
                    little = ids.astype("<u4")
                    out = enc.decode(ids)
                    sha_ids = [hashlib.sha256(little[a:b]).hexdigest() for a, b in zip(rows[:-1], rows[1:], strict=True)]
                    ends = np.append(at, len(out))[rows]
                    sha_out = [hashlib.sha256(out[a:b]).hexdigest() for a, b in zip(ends[:-1], ends[1:], strict=True)]
                    cols = [pa.array(sha_ids, pa.string()), pa.array(sha_out, pa.string())]
                else:
                    at = at - np.repeat(offs[:-1], rows[1:] - rows[:-1])
                    cols = [pa.LargeListArray.from_arrays(rows, pa.array(x.astype(np.int64))).cast(pa.list_(pa.int64())) for x in (ids, at)]
                yield pa.RecordBatch.from_arrays([keys.slice(lo, hi - lo).cast(pa.int64()), n, *cols], names=[x.split()[0] for x in schema.split(", ")])

    return df.select(id_col, text_col).mapInArrow(run, schema)


def query(spark, sf_dir: str):
    import public_tokenizers

    from .textblocks import read_table

    return encode_table(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
