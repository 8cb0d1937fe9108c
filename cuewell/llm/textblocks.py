"""Vectorised primitives on Arrow string columns: byte blocks, word spans, span hashes.

A text column arrives as one UTF-8 byte buffer plus offsets.  All operators that touch every word
work on that buffer with numpy, in blocks of bounded size, never character by character.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 1 << 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_rng = np.random.Generator(np.random.PCG64(20240607))
_BYTE_CODE = _rng.integers(1, 2**63, size=256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_BASE_INV = pow(_BASE, -1, 1 << 64)
_powers: dict[str, np.ndarray] = {}


def _power_table(name: str, base: int, n: int) -> np.ndarray:
    t = _powers.get(name)
    if t is None or len(t) < n:
        size = max(n, BLOCK_BYTES + 1)
        t = np.ones(size, dtype=np.uint64)
        t[1:] = np.uint64(base)
        np.multiply.accumulate(t, out=t)
        if size <= 4 * BLOCK_BYTES:
            _powers[name] = t
    return t[:n]


def separator_table(separators: bytes) -> np.ndarray:
    """256 booleans: true for a byte that belongs to a word."""
    t = np.ones(256, dtype=bool)
    t[list(separators)] = False
    return t


#: Words of the shingle and quality operators: runs of anything but ASCII white space.
WORD_BYTES = separator_table(b" \t\n\x0b\x0c\r")


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def column_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null counts as empty text."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = pc.fill_null(col, "")
    if not pa.types.is_large_string(col.type):
        col = col.cast(pa.large_string())
    bufs = col.buffers()
    offs = np.frombuffer(bufs[1], dtype=np.int64)[col.offset : col.offset + len(col) + 1] if len(col) else np.zeros(1, np.int64)
    data = np.frombuffer(bufs[2], dtype=np.uint8) if bufs[2] is not None and bufs[2].size else np.zeros(0, np.uint8)
    return data, offs


def blocks(col: pa.Array, limit: int = BLOCK_BYTES):
    """Yields (lo, hi, data, offs): rows lo..hi and their bytes, offsets from 0.

    A block ends before it passes ``limit`` bytes; a single longer text is a block of its own.
    """
    data, offs = column_bytes(col)
    n, lo = len(offs) - 1, 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + limit, "right")) - 1)
        hi = min(hi, n)
        yield lo, hi, data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi


def word_spans(data: np.ndarray, offs: np.ndarray, table: np.ndarray = WORD_BYTES):
    """Starts, ends and row numbers of all words; words never cross rows."""
    n = len(data)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, z
    w = table[data]
    st, en = w.copy(), w.copy()
    st[1:] &= ~w[:-1]
    en[:-1] &= ~w[1:]
    first = offs[:-1][offs[:-1] < offs[1:]]
    last = offs[1:][offs[:-1] < offs[1:]] - 1
    st[first] = w[first]
    en[last] = w[last]
    starts = np.flatnonzero(st)
    ends = np.flatnonzero(en) + 1
    return starts, ends, np.searchsorted(offs, starts, "right") - 1


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; every input bit reaches every output bit."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Prefix sums of byte codes times powers, modulo 2**64; feeds span_hashes."""
    p = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_BYTE_CODE[data] * _power_table("up", _BASE, len(data)), out=p[1:])
    return p


def span_hashes(p: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans; the same bytes hash alike wherever they stand."""
    inv = _power_table("down", _BASE_INV, len(p))
    return mix((p[ends] - p[starts]) * inv[starts] + (ends - starts).astype(np.uint64))


def ragged_take(flat: np.ndarray, offs: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Concatenates the runs flat[offs[i]:offs[i+1]] for i in which; also their new offsets."""
    lens = (offs[1:] - offs[:-1])[which]
    out = np.zeros(len(which) + 1, np.int64)
    np.cumsum(lens, out=out[1:])
    idx = np.arange(out[-1], dtype=np.int64) + np.repeat(offs[:-1][which] - out[:-1], lens)
    return flat[idx], out


def per_row_counts(rows: np.ndarray, n: int, weights: np.ndarray | None = None) -> np.ndarray:
    return np.bincount(rows, weights=weights, minlength=n)


def read_table(spark, sf_dir: str, name: str):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
