"""Operator 4: licence scan with a positional rare-token index.

Templates are word sequences, kept by the position of each word.
Words get their inverse document frequency from the whole corpus (one counting pass
over the template vocabulary).  Each template is looked for around every place of its mandatory
phrases: its rarest words vote there for file position - template position.  They are so many that
the other words together can't reach the least agreement, so no alignment is missed, whatever else
the file holds.  A template is reported when the words at an alignment agree well enough and one of
its mandatory phrases stands there whole.

Base phrases are found at every place.  Null or empty text: no words, score 0.  Repeats count each.
Every row gives one row, with its id as it is, null and repeated ids included.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from .textblocks import blocks, lower_ascii, prefix_sums, separator_table, span_hashes

# Phrases of the base scan and their labels.
BASE_PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
_GNU = (
    "this program is free software you can redistribute it and or modify it under the terms of the {} as published by the free software foundation "
    "either version {} of the license or at your option any later version this program is distributed in the hope that it will be useful but without any "
    "warranty without even the implied warranty of merchantability or fitness for a particular purpose see the {} for more details"
)
_GPL, _LGPL, _AGPL = "gnu general public license", "gnu lesser general public license", "gnu affero general public license"
# Public template wordings as word sequences, short references and whole notices; the first
# element of each pair lists mandatory phrases, any of which must stand in the file at the template's alignment.
TEMPLATES = {
    "mit": [
        (["under the mit license"], "released under the mit license"),
        (["permission is hereby granted free of charge"], "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
        (
            ["permission is hereby granted free of charge"],
            "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the "
            "software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the "
            "software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this "
            "permission notice shall be included in all copies or substantial portions of the software",
        ),
    ],
    "isc": [
        (
            ["permission to use copy modify and or distribute this software"],
            "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright "
            "notice and this permission notice appear in all copies",
        ),
    ],
    "apache-2": [
        (["apache license version 2"], "licensed under the apache license version 2 0"),
        (
            ["apache license version 2"],
            "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the "
            "license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is "
            "distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing "
            "permissions and limitations under the license",
        ),
    ],
    "cc-by-nc": [
        (["cc by nc", "creative commons attribution noncommercial"], "licensed under cc by nc 4 0"),
    ],
    "cc-by": [
        (["creative commons attribution 4 0"], "licensed under the creative commons attribution 4 0 international license"),
    ],
    "cc-by-sa": [
        (["creative commons attribution sharealike"], "licensed under the creative commons attribution sharealike 4 0 international license"),
    ],
    "cc0": [
        (["waived all copyright and related or neighboring rights"], "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"),
    ],
    "gpl-3": [
        ([f"{_GPL} version 3", "gnu gpl version 3"], f"this work is licensed under the {_GPL} version 3"),
        ([f"{_GPL} as published by the free software foundation either version 3"], _GNU.format(_GPL, 3, _GPL)),
    ],
    "gpl-2": [
        ([f"{_GPL} version 2", "gnu gpl version 2"], f"this work is licensed under the {_GPL} version 2"),
        ([f"{_GPL} as published by the free software foundation either version 2"], _GNU.format(_GPL, 2, _GPL)),
    ],
    "lgpl": [
        ([_LGPL], f"licensed under the {_LGPL}"),
        ([_LGPL], _GNU.format(_LGPL, 3, _LGPL)),
    ],
    "agpl": [
        ([_AGPL], f"licensed under the {_AGPL}"),
        ([_AGPL], _GNU.format(_AGPL, 3, _AGPL)),
    ],
    "mpl-2": [
        (["mozilla public license"], "subject to the terms of the mozilla public license v 2 0"),
        (
            ["mozilla public license"],
            "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain "
            "one at http mozilla org mpl 2 0",
        ),
    ],
    "bsd": [
        (["redistribution and use in source and binary forms"], "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
        (
            ["redistribution and use in source and binary forms"],
            "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions "
            "of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the "
            "above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
        ),
    ],
    "unlicense": [
        (
            ["free and unencumbered software released into the public domain"],
            "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software "
            "either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means",
        ),
    ],
    "zlib": [
        (
            ["permission is granted to anyone to use this software for any purpose"],
            "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of "
            "this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely",
        ),
    ],
}

#: Words are runs of a-z, 0-9 and anything beyond ASCII, after lower-casing A-Z.
SCAN_BYTES = separator_table(bytes([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]))
MIN_AGREE = 0.6
#: Phrase places looked at together.
PLACES = 1024
SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def _hash_words(words: list[str]) -> np.ndarray:
    data = np.frombuffer("".join(words).encode(), np.uint8)
    ends = np.cumsum([len(w.encode()) for w in words])
    return span_hashes(prefix_sums(data), ends - [len(w.encode()) for w in words], ends)


class Index:
    """Template words by position and the phrases, all by word hash."""

    def __init__(self):
        self.templates = [(label, _hash_words(text.split()), [_hash_words(p.split()) for p in must]) for label, forms in TEMPLATES.items() for must, text in forms]
        self.base = [(label, _hash_words(p.split())) for p, label in BASE_PHRASES.items()]
        extra = {h for _, words, _ in self.templates for h in words.tolist()} | {h for _, p in self.base for h in p.tolist()} | {h for _, _, ps in self.templates for p in ps for h in p.tolist()}
        self.vocab = np.array(sorted(extra), dtype=np.uint64)


def _stream(batches, index: Index):
    """Per block: (keys lo, word starts' rows, vocabulary number of each word or -1, row word offsets)."""
    for batch in batches:
        for lo, hi, data, offs in blocks(batch.column(batch.num_columns - 1)):
            low = lower_ascii(data)
            n = len(low)
            w = SCAN_BYTES[low]
            st = w.copy()
            if n:
                st[1:] &= ~w[:-1]
                first = offs[:-1][offs[:-1] < offs[1:]]
                st[first] = w[first]
            starts = np.flatnonzero(st)
            en = w.copy()
            if n:
                en[:-1] &= ~w[1:]
                last = offs[1:][offs[:-1] < offs[1:]] - 1
                en[last] = w[last]
            ends = np.flatnonzero(en) + 1
            hashes = span_hashes(prefix_sums(low), starts, ends)
            at = np.minimum(np.searchsorted(index.vocab, hashes), len(index.vocab) - 1)
            number = np.where(index.vocab[at] == hashes, at, -1)
            yield batch, lo, hi, number, np.searchsorted(starts, offs, "left")


def vocabulary_counts(df, text_col: str = "text"):
    """Documents that hold each template word, over all documents: (word, df), and (-1, documents)."""

    def run(batches):
        index = Index()
        total, docs = np.zeros(len(index.vocab), np.int64), 0
        for _, lo, hi, number, rows in _stream(batches, index):
            docs += hi - lo
            hit = np.flatnonzero(number >= 0)
            doc = np.searchsorted(rows, hit, "right") - 1
            pairs = np.unique(doc * len(index.vocab) + number[hit])
            total += np.bincount(pairs % len(index.vocab), minlength=len(index.vocab))
        yield pa.RecordBatch.from_arrays([pa.array(np.append(np.arange(len(total)), -1), pa.int64()), pa.array(np.append(total, docs), pa.int64())], names=["word", "n"])

    from pyspark.sql import functions as F

    return df.select(text_col).mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _phrase_places(number: np.ndarray, phrase: np.ndarray) -> np.ndarray:
    """Starts of a phrase in one block's word numbers (places across rows are dropped later)."""
    if len(number) < len(phrase):
        return np.zeros(0, np.int64)
    at = np.flatnonzero(number[: len(number) - len(phrase) + 1] == phrase[0])
    for k in range(1, len(phrase)):
        at = at[number[at + k] == phrase[k]]
    return at


def _rarest(seq: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Positions of a template's rarest words, so many that no alignment without any of them agrees enough."""
    weight = idf[seq]
    order = np.argsort(-weight, kind="stable")
    left = weight.sum() - np.cumsum(weight[order])
    return order[: int(np.argmax(left < (MIN_AGREE - 1e-6) * weight.sum())) + 1]


def _scan_file(words: np.ndarray, lo: int, hi: int, idf: np.ndarray, templates, places):
    """Labels and the best agreement of one file: each template's rarest words vote near its mandatory phrases.

    places: for each template the (start, length) pairs of its mandatory phrases in the file.
    """
    best, labels = 0.0, set()
    for t, (label, seq, _, rare) in enumerate(templates):
        weight = idf[seq]
        for k in range(0, len(places[t]), PLACES):
            # An alignment holds a phrase when it starts between these two.
            near = np.unique(np.concatenate([np.arange(p + m - 8 - len(seq), p + 9) for p, m in places[t][k : k + PLACES]]))
            votes = []
            for pos in rare.tolist():
                at = near + pos
                inside = (at >= lo) & (at < hi)
                votes.append(near[inside][words[at[inside]] == seq[pos]])
            shifts = np.unique(np.concatenate(votes))
            if not len(shifts):
                continue
            at = shifts[:, None] + np.arange(len(seq))
            agree = (at >= lo) & (at < hi) & (words[np.clip(at, lo, hi - 1)] == seq)
            score = float((agree * weight).sum(axis=1).max() / weight.sum())
            if score >= MIN_AGREE:
                labels.add(label)
                best = max(best, score)
    return labels, best


def scan(df, id_col: str = "doc_id", text_col: str = "text"):
    """One row per document: base places and labels, and the labels of the template index."""
    counts = {r["word"]: r["n"] for r in vocabulary_counts(df, text_col).collect()}  # as many rows as template words

    def run(batches):
        index = Index()
        num = {h: i for i, h in enumerate(index.vocab.tolist())}
        n_docs = max(1, counts.get(-1) or 0)
        idf = np.log((1 + n_docs) / (1 + np.array([counts.get(i, 0) for i in range(len(num))]))) + 1e-9
        as_num = lambda hs: np.array([num[h] for h in hs.tolist()])
        templates = [(label, as_num(words), [as_num(m) for m in must]) for label, words, must in index.templates]
        templates = [(label, seq, must, _rarest(seq, idf)) for label, seq, must in templates]
        base = [(label, as_num(p)) for label, p in index.base]
        for batch, lo, hi, number, rows in _stream(batches, index):
            n = hi - lo
            n_base, first, last = np.zeros(n, np.int64), np.full(n, -1), np.full(n, -1)
            base_labels = [set() for _ in range(n)]
            for label, phrase in base:
                at = _phrase_places(number, phrase)
                doc = np.searchsorted(rows, at, "right") - 1
                ok = at + len(phrase) <= rows[doc + 1]
                for p, d in zip((at[ok] - rows[doc[ok]]).tolist(), doc[ok].tolist(), strict=True):
                    n_base[d] += 1
                    first[d] = p if first[d] < 0 else min(first[d], p)
                    last[d] = max(last[d], p)
                    base_labels[d].add(label)
            labels, score = [set(x) for x in base_labels], np.zeros(n)
            score[[bool(x) for x in base_labels]] = 1.0
            # A template can only stand where one of its mandatory phrases does.
            places: dict[int, list] = {}
            for t, (_, _, must, _) in enumerate(templates):
                for m in must:
                    at = _phrase_places(number, m)
                    doc = np.searchsorted(rows, at, "right") - 1
                    ok = at + len(m) <= rows[doc + 1]
                    for p, d in zip(at[ok].tolist(), doc[ok].tolist(), strict=True):
                        places.setdefault(d, [[] for _ in templates])[t].append((p, len(m)))
            for d, where in places.items():
                found, best = _scan_file(number, rows[d], rows[d + 1], idf, templates, where)
                labels[d] |= found
                score[d] = max(score[d], best)
            none = n_base == 0
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).slice(lo, n).cast(pa.int64()),
                    pa.array(rows[1:] - rows[:-1], pa.int64()),
                    pa.array(n_base, pa.int64()),
                    pa.array(first, pa.int64(), mask=none),
                    pa.array(last, pa.int64(), mask=none),
                    pa.array([",".join(sorted(x)) for x in base_labels], pa.string()),
                    pa.array([",".join(sorted(x)) for x in labels], pa.string()),
                    pa.array(np.minimum(score, 1.0), pa.float64()),
                ],
                names=[c.split()[0] for c in SCHEMA.split(", ")],
            )

    return df.select(id_col, text_col).mapInArrow(run, SCHEMA)


def query(spark, sf_dir: str):
    from .textblocks import read_table

    return scan(read_table(spark, sf_dir, "documents"))
