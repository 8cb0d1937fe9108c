"""Text analysis of Arrow batches: one pass over the tokens, each distinct token worked out once.

The rules are those of ``text`` (Column functions, for single expressions); here they run over whole
batches with a bounded cache, so a fact costs look-ups, not nested array functions.
"""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import pyarrow as pa

from . import lexicon as lex

CACHE = 1 << 17
FIRST, MOST = 5, 10
NOWHERE = 1_000_000
_SPACE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
_STOP, _FILLERS, _NUMBERS = frozenset(lex.STOP), frozenset(lex.FILLERS), frozenset(lex.NUMBERS)
_BLOCKED = _STOP | frozenset(lex.STOP_VALUES)
_OWN, _OTHERS = frozenset(["my", "i", "im", "mine"]), frozenset(["her", "his", "its", "their", "your"])
_DIGIT, _DIGITS = re.compile("[0-9]"), re.compile("^[0-9]+$")


def trim(text: str) -> str:
    """The text without white space around it."""
    a, b = 0, len(text)
    m = _SPACE.match(text)
    if m:
        a = m.end()
    while b > a and _SPACE.match(text[b - 1]):
        b -= 1
    return text[a:b]


def tokens(text: str) -> list[str]:
    return [x for x in _SPACE.split(text) if x]


def clean_word(w: str) -> str:
    t = w.strip(lex.TRIM_MATCH).lower()
    return t[:-2] if t.endswith(("'s", "’s")) else t


def stem(w: str) -> str:
    w = lex.IRREGULAR.get(w, w)
    n = len(w.encode())
    if n >= 5 and w.endswith("ies"):
        w = w[:-3] + "y"
    elif n >= 4 and w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    return w[:6] if len(w) >= 8 else w[:5] if len(w) >= 5 else w


def root(w: str) -> str:
    w = w.strip(lex.TRIM_MATCH).lower()
    w = lex.IRREGULAR.get(w, w)
    n = len(w.encode())
    for s in lex.SUFFIXES:
        if n >= len(s) + 3 and w.endswith(s):
            return w[: -len(s)]
    return w


def canon(w: str) -> str:
    c = clean_word(w)
    if c in lex.SYNONYMS:
        return lex.SYNONYMS[c]
    bare = c.rstrip("s")
    return lex.SYNONYMS.get(bare, c) if len(bare.encode()) >= 3 else c


class Token:
    """What one token is, wherever it stands."""

    __slots__ = ("again", "capital", "clean", "clip", "low", "looks", "long", "number", "open", "stem", "stop", "usable", "value_stem")

    def __init__(self, w: str):
        self.clip = w.strip(lex.TRIM_SHOW)
        self.low = self.clip.lower()
        self.clean = clean_word(w)
        self.again = clean_word(self.clip)
        self.stem = stem(self.clean)
        self.value_stem = stem(self.low)
        digit = bool(_DIGIT.search(self.low))
        self.capital = bool(self.clip) and unicodedata.category(self.clip[0]) == "Lu"
        self.number = bool(_DIGIT.search(self.clip)) or self.low in _NUMBERS
        self.stop = self.low in _BLOCKED
        size = len(self.low.encode())
        signal = any(unicodedata.category(c)[0] in "LN" for c in self.low)
        self.usable = bool(self.low) and not self.stop and signal and (size >= 3 or bool(_DIGITS.match(self.low)))
        self.looks = 3.0 if digit else None
        self.long = 0.6 if size >= 7 else 0.0
        self.open = self.capital and not self.stop


_tokens: dict[str, Token] = {}
_roots: dict[str, tuple[str, str]] = {}


def _token(w: str) -> Token:
    t = _tokens.get(w)
    if t is None:
        if len(_tokens) >= CACHE:
            _tokens.clear()
        t = _tokens[w] = Token(w)
    return t


def roots_of(words: list[str]) -> list[str]:
    """Roots of words and of the words that stand for them, sorted."""
    out = set()
    for w in words:
        r = _roots.get(w)
        if r is None:
            if len(_roots) >= CACHE:
                _roots.clear()
            r = _roots[w] = (root(w), root(canon(w)))
        out.update(r)
    return sorted(out)


def episode(text: str):
    """(tok, tok_stems, raw, s, pos, roots, c, cand, head, self_flag) of a fact; None where there is no fact."""
    trimmed = trim(text)
    tok = tokens(trimmed)
    ts = [_token(w) for w in tok]
    seen = {t.clean for t in ts}
    raw = sorted(seen - _STOP - {""})
    if not raw or not (len(tok) >= 3 or ":" in trimmed or any(_DIGIT.search(w) for w in raw)):
        return None
    ranked = sorted((-((t.looks if t.looks is not None else 2.0 if t.capital and i > 0 else 0.0) + t.long + 0.15 * i), i) for i, t in enumerate(ts) if t.usable)
    if not ranked:
        return None
    rest = [i for _, i in ranked[FIRST:] if ts[i].number or ts[i].capital]
    keep = [i for _, i in ranked[:FIRST]] + rest[: MOST - FIRST]
    stems = [t.stem for t in ts]
    s = sorted({stem(w) for w in raw})
    first: dict[str, int] = {}
    for i, x in enumerate(stems):
        first.setdefault(x, i)
    low_at: dict[str, int] = {}
    clean_at: dict[str, int] = {}
    for i, t in enumerate(ts):
        low_at.setdefault(t.low, i)
        clean_at.setdefault(t.clean, i)
    cand = []
    for i in keep:
        t = ts[i]
        at = low_at.get(t.low, NOWHERE)
        grown = t.clip
        if t.capital and not _DIGIT.search(t.clip):
            lo = hi = at
            while lo > 0 and ts[lo - 1].open:
                lo -= 1
            while hi + 1 < len(ts) and ts[hi + 1].open:
                hi += 1
            if hi > lo:
                grown = " ".join(x.clip for x in ts[lo : hi + 1])
        cand.append((t.clip, t.value_stem, min(at, clean_at.get(t.again, NOWHERE)), t.number, grown))
    head = next((t.stem for t in ts if t.clean and t.clean not in _STOP and t.clean not in _FILLERS), "")
    mine = not seen.isdisjoint(_OWN) and seen.isdisjoint(_OTHERS) and "name" in s
    return tok, stems, raw, s, [first.get(x, -1) for x in s], roots_of(raw), cand, head, mine


_RELATIONS, _PET = frozenset(lex.RELATION_STEMS), frozenset(["pet", lex.stem_word("animal")])
_MANY = frozenset(["many", "much", lex.stem_word("number")])


def cue(text: str, expand: bool = True):
    """(q, cue, pet_query, name_query, want_number) of a query; None without content."""
    q = [w for w in dict.fromkeys(_token(w).clean for w in tokens(text)) if w and w not in _STOP]
    if not q:
        return None
    own = {stem(w) for w in q}
    if expand:
        own |= {stem(lex.SYNONYMS[w]) for w in q if w in lex.SYNONYMS}
    return q, sorted(own), not own.isdisjoint(_PET), "name" in own and own.isdisjoint(_RELATIONS), not own.isdisjoint(_MANY)


def lists(rows: list[list], kind: pa.DataType) -> pa.ListArray:
    """Lists as one Arrow array, from their concatenation."""
    offs = np.zeros(len(rows) + 1, np.int32)
    np.cumsum([len(r) for r in rows], out=offs[1:])
    return pa.ListArray.from_arrays(pa.array(offs), pa.array([x for r in rows for x in r], kind))


EPISODE = (
    "tok array<string>, raw array<string>, tok_stems array<string>, c array<string>, s array<string>, "
    "cand array<struct<w:string,st:string,p:int,num:boolean,x:string>>, v string, pos array<int>, roots array<string>, head string, self_flag boolean"
)


def episodes_of(batch: pa.RecordBatch, text_at: int) -> list[pa.Array]:
    """The episode columns of a batch's facts, behind the batch's own columns of the same rows."""
    found = [None if t is None else episode(t) for t in batch.column(text_at).to_pylist()]
    kept = batch.filter(pa.array([f is not None for f in found], pa.bool_()))
    rows = [f for f in found if f is not None]
    col = lambda i: [r[i] for r in rows]
    flat = [x for r in rows for x in r[6]]
    kinds = (("w", pa.string()), ("st", pa.string()), ("p", pa.int32()), ("num", pa.bool_()), ("x", pa.string()))
    parts = pa.StructArray.from_arrays([pa.array([x[k] for x in flat], t) for k, (_, t) in enumerate(kinds)], names=[n for n, _ in kinds])
    offs = np.zeros(len(rows) + 1, np.int32)
    np.cumsum([len(r[6]) for r in rows], out=offs[1:])
    text = pa.string()
    return [
        *kept.columns,
        lists(col(0), text),
        lists(col(2), text),
        lists(col(1), text),
        lists([[x[0] for x in r[6]] for r in rows], text),
        lists(col(3), text),
        pa.ListArray.from_arrays(pa.array(offs), parts),
        pa.array([r[6][0][0] for r in rows], text),
        lists(col(4), pa.int32()),
        lists(col(5), text),
        pa.array(col(7), text),
        pa.array(col(8), pa.bool_()),
    ]


CUE = "q array<string>, cue array<string>, pet_query boolean, name_query boolean, want_number boolean"


def cues_of(batch: pa.RecordBatch, text_at: int, expand: bool) -> list[pa.Array]:
    """The cue columns of a batch's queries, behind the batch's own columns; queries without content go."""
    found = [None if t is None else cue(t, expand) for t in batch.column(text_at).to_pylist()]
    kept = batch.filter(pa.array([f is not None for f in found], pa.bool_()))
    rows = [f for f in found if f is not None]
    flags = [pa.array([r[i] for r in rows], pa.bool_()) for i in (2, 3, 4)]
    return [*kept.columns, lists([r[0] for r in rows], pa.string()), lists([r[1] for r in rows], pa.string()), *flags]
