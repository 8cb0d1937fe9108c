"""Operator 2: vector bin packing of tokenised documents into fixed-length sequences.

A document is its token ids plus a terminator.  Whole sequence lengths are cut off first; what is
left of a document is an item with a demand vector (tokens, segments, loss-bearing tokens).  Bins
are filled one at a time: of a buffer of items, the one whose demand has the largest dot product
with the bin's remaining capacity (both relative to the limits) goes next.  When no item fits
whole, the largest is cut to fill the gap, so that only each task's last sequence needs padding.

Everything happens inside a task over its own input partition: no shuffle, bounded buffers, and a
lost task gives the same rows again because file splits are read in the same order.  Null or empty
text is a document of the terminator alone.  Equal documents are packed each on its own.
"""

from __future__ import annotations

import functools
import json
import zlib

import numpy as np
import pyarrow as pa

from .byte_bpe import Encoder, PairTable
from .textblocks import blocks

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


@functools.cache
def _byte_symbols() -> list[str]:
    """The printable symbol that byte-level vocabularies write for each byte."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(keep)]
    return [chr(b) if b in set(keep) else chr(256 + rest.index(b)) for b in range(256)]


def encoder_of(path: str) -> Encoder:
    """An encoder with the vocabulary and merges of a ``tokenizers`` file; special strings are text."""
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    vocab = tok.get_vocab(with_added_tokens=False)
    merges = [m if isinstance(m, list) else m.split(" ") for m in json.loads(tok.to_str())["model"]["merges"]]
    symbols = _byte_symbols()
    back = {s: b for b, s in enumerate(symbols)}
    table = [b""] * (max(vocab.values()) + 1)
    for t, i in vocab.items():
        if all(c in back for c in t):
            table[i] = bytes(back[c] for c in t)
    pairs = {(vocab[a], vocab[b]): vocab[a + b] for a, b in merges}
    ranked = list(pairs.values())
    if ranked != sorted(ranked):
        raise ValueError("the file's merges aren't in the order of their ids")
    return Encoder(PairTable(np.array([vocab[s] for s in symbols]), pairs), table)


class Packer:
    """Fills sequences of ``capacity`` tokens, ``max_segments`` pieces and ``max_loss`` loss tokens."""

    def __init__(self, capacity: int = 1024, max_segments: int = 128, max_loss: int = 1024, buffer: int = 2048, min_cut: int = 8, first_id: int = 0):
        self.limits = np.array([capacity, max_segments, max_loss], dtype=np.float64)
        self.capacity, self.buffer, self.min_cut = capacity, buffer, min_cut
        self.next_id = first_id
        self.demand = np.zeros((0, 3))
        self.items: list[tuple] = []  # (document, start, ids, total)
        self.rows: list[tuple] = []

    def _emit(self, doc, start, ids, total, offset):
        self.rows.append((doc, start, len(ids), zlib.crc32(ids.tobytes()), total, self.next_id, offset))

    def add(self, docs: list[tuple]):
        """docs: (document, ids as little-endian uint32, number of trailing ids without loss)."""
        cap, new = self.capacity, []
        max_loss = int(self.limits[2])
        for doc, ids, quiet in docs:
            total, at, step = len(ids), 0, min(cap, max_loss)
            while total - at >= cap:
                self._emit(doc, at, ids[at : at + step], total, 0)
                self.next_id += 1
                at += step
            if at < total:
                self.items.append((doc, at, ids[at:], total))
                new.append((total - at, 1, max(0, total - at - quiet)))
        if new:
            self.demand = np.vstack([self.demand, np.array(new, dtype=np.float64)])
        if len(self.items) >= 2 * self.buffer:
            self._fill(self.buffer)

    def finish(self):
        self._fill(0)

    def _fill(self, leave: int):
        dead = np.zeros(len(self.items), bool)
        left = len(self.items)
        demand = self.demand.copy()
        while left > leave:
            room, offset = self.limits.copy(), 0
            while left and room[0] > 0:
                fits = (demand <= room).all(axis=1) & ~dead
                k = int(np.argmax(np.where(fits, demand / self.limits @ (room / self.limits), -1.0)))
                if fits[k]:
                    doc, start, ids, total = self.items[k]
                    self._emit(doc, start, ids, total, offset)
                    room -= demand[k]
                    offset += len(ids)
                    dead[k] = True
                    left -= 1
                    continue
                cut = int(min(room[0], room[2]))
                if room[1] < 1 or cut < self.min_cut:
                    break
                k = int(np.argmax(np.where(dead, -1.0, demand[:, 0])))
                doc, start, ids, total = self.items[k]
                if len(ids) <= cut:
                    break
                self._emit(doc, start, ids[:cut], total, offset)
                self.items[k] = (doc, start + cut, ids[cut:], total)
                demand[k] -= (cut, 0, min(cut, demand[k, 2]))
                break
            self.next_id += 1
        keep = np.flatnonzero(~dead)
        self.items = [self.items[k] for k in keep.tolist()]
        self.demand = demand[keep]

    def take(self) -> pa.RecordBatch:
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        cols = list(zip(*self.rows, strict=True)) if self.rows else [[]] * len(names)
        self.rows = []
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=names)


def pack_documents(df, tokenizer_path: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", **limits):
    """Pieces of all documents with the sequence and offset that hold them."""

    def run(batches):
        from pyspark import TaskContext

        enc = encoder_of(tokenizer_path)
        ctx = TaskContext.get()
        packer = Packer(first_id=(ctx.partitionId() if ctx else 0) << 36, **limits)
        for batch in batches:
            keys = batch.column(0).to_pylist()
            for lo, _, data, offs in blocks(batch.column(1)):
                ids, rows, _ = enc.encode(data, offs)
                little = np.insert(ids.astype("<u4"), rows[1:], end_id)
                ends = (rows + np.arange(len(rows))).tolist()
                packer.add([(keys[lo + i], little[ends[i] : ends[i + 1]], 1) for i in range(len(ends) - 1)])
                if packer.rows:
                    yield packer.take()
        packer.finish()
        yield packer.take()

    return df.select(id_col, text_col).mapInArrow(run, SCHEMA)


def query(spark, sf_dir: str):
    import public_tokenizers

    from .textblocks import read_table

    return pack_documents(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
