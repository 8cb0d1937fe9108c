"""Recall over a base scope and its documents: one pass over the texts, a scope at a time.

A task reads a scope's facts in order and looks at the words that some query of the family holds; it keeps k
facts for each query over its scopes.  Only facts that may be among them are analysed whole, so neither
episodes nor an index are stored.  The rules are those of recall_many.
"""

from __future__ import annotations

from collections import defaultdict, deque

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import analysis
from ..functions import lexicon as lex
from ..functions import text as T
from .encode import encode
from .recall import HIT, ROOT_WINDOW, _answer

_STOP, _PETS, _STOP_VALUES = frozenset(lex.STOP), frozenset(lex.PET_STEMS), frozenset(lex.STOP_VALUE_STEMS)
_FOUND = "qid long, scope string, place int, idx long, t string, coverage double, overlap int, exact int, cue array<string>, want_number boolean"


def best_across(queries: DataFrame, rows: DataFrame, k: int, messages: bool = False) -> DataFrame:
    """Hits of queries over their families.  rows: (scope, seq, text) of facts, seq being their idx; or of messages,
    whose facts are numbered in order."""
    from .store import MAX_SENTENCES

    parts = int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    base = F.regexp_extract("scope", r"^(.*?)(?:__.*)?$", 1)
    held = rows.select(F.pmod(F.xxhash64("scope"), F.lit(parts)).cast("int").alias("g"), F.lit(1).alias("role"), base.alias("base"), "scope", F.col("seq").cast("long").alias("seq"), F.col("text").alias("t"))
    asked = queries.select(F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("g"), F.lit(0).alias("role"), F.col("scope").alias("base"), F.lit("").alias("scope"), F.col("qid").cast("long").alias("seq"), F.col("query").alias("t"))
    dealt = asked.unionByName(held).repartitionById(parts, "g").sortWithinPartitions("g", "role", "base", "scope", "seq")
    if messages:
        own = F.when(F.col("role") == 0, F.array("t")).otherwise(T.sentences(F.col("t"), MAX_SENTENCES))
        dealt = dealt.select("g", "role", "base", "scope", "seq", F.explode(own).alias("t")).where("role = 0 OR NOT contains(t, '?')")

    def run(batches):
        group, at, fact, families = None, None, None, {}
        for b in batches:
            for g, role, name, scope, seq, t in zip(*(b.column(i).to_pylist() for i in range(6)), strict=True):
                if g != group:
                    if fact:
                        fact.settle()
                    yield from (x for f in families.values() for x in f.found())
                    group, at, fact, families = g, None, None, {}
                if role == 0:
                    if name not in families:
                        families[name] = Family(k)
                    families[name].ask(seq, t)
                    continue
                if (name, scope) != at:
                    if fact:
                        fact.settle()
                    at, family = (name, scope), families.get(name)
                    inside = family is not None and (scope == name or scope.startswith(f"{name}__"))
                    fact = Scope(family, scope) if inside else None
                if fact and t is not None and (not messages or is_fact(t)):
                    fact.add(fact.n if messages else seq, t)
        if fact:
            fact.settle()
        yield from (x for f in families.values() for x in f.found())

    hits = dealt.mapInArrow(run, _FOUND)
    order = Window.partitionBy("qid").orderBy(F.desc("exact"), F.desc("overlap"), F.desc("coverage"), "scope", "place")
    hits = hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).drop("place")
    return _answer(encode(hits)).select(HIT)


def words_of(text: str) -> list[str]:
    """analysis.tokens, by the faster split wherever it is the same."""
    return analysis.tokens(text) if any(c in text for c in "\x1c\x1d\x1e\x1f") else text.split()


def is_fact(text: str) -> bool:
    """Whether analysis.episode finds a fact in the text."""
    tok = words_of(text)
    raw = usable = False
    for w in tok:
        t = analysis._token(w)
        raw = raw or (t.clean != "" and t.clean not in _STOP)
        usable = usable or t.usable
        if raw and usable:
            break
    if not (raw and usable):
        return False
    return len(tok) >= 3 or ":" in text or any(analysis._DIGIT.search(c) for c in {analysis._token(w).clean for w in tok} - _STOP)


class Family:
    """The queries of a base scope, the words that they hold, and the best of each so far."""

    def __init__(self, k: int):
        self.k, self.ids, self.asks, self.best = k, [], [], []
        self.by_stem, self.words, self.pets = defaultdict(list), set(), False
        self.open: set[int] = set()  # queries that a hit by roots may still join
        self.dull: set[str] = set()
        self.live: dict[str, tuple[str | None, str | None]] = {}

    def ask(self, qid, text) -> None:
        c = None if text is None else analysis.cue(text)
        if c is None:
            return
        i = len(self.ids)
        self.ids.append(qid)
        self.asks.append((frozenset(c[0]), c[1], frozenset(c[1]), c[2], c[4], frozenset(analysis.roots_of(c[0])), not {"many", "much", "number"}.isdisjoint(c[0])))
        self.best.append([])
        self.open.add(i)
        self.words.update(c[0])
        for x in c[1]:
            self.by_stem[x].append(i)
        self.pets = self.pets or c[2]

    def look(self, w: str):
        """What a token means to the queries: (word, stem), or None."""
        t = analysis._token(w)
        if t.clean and t.clean not in _STOP and (t.clean in self.words or t.stem in self.by_stem or (self.pets and t.stem in _PETS)):
            if len(self.live) >= analysis.CACHE:
                self.live.clear()
            out = self.live[w] = (t.clean, t.stem)
            return out
        if len(self.dull) >= analysis.CACHE:
            self.dull.clear()
        self.dull.add(w)
        return None

    def keep(self, i: int, hits: list) -> None:
        """hits: (-exact, -overlap, -coverage, scope, place, idx, t, cue, want_number)."""
        best = self.best[i] = sorted([*self.best[i], *hits], key=lambda h: h[:5])[: self.k]
        if len(best) == self.k and best[-1][0] < 0:
            self.open.discard(i)

    def found(self):
        rows = [(q, h) for q, best in zip(self.ids, self.best, strict=True) for h in best]
        kinds = (pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.string(), pa.float64(), pa.int32(), pa.int32(), pa.list_(pa.string()), pa.bool_())
        cols = ([q for q, _ in rows], *([h[j] for _, h in rows] for j in (3, 4, 5, 6)), *([-h[j] for _, h in rows] for j in (2, 1, 0)), *([h[j] for _, h in rows] for j in (7, 8)))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, x) for c, x in zip(cols, kinds, strict=True)], names=[c.split()[0] for c in _FOUND.split(", ")])


class Scope:
    """The facts of one scope, as they come."""

    def __init__(self, family: Family, name: str):
        self.family, self.name, self.n, self.top = family, name, 0, None
        self.met: list[tuple] = []  # (idx, text, words, stems) of facts that hold an asked one
        self.last: deque = deque(maxlen=ROOT_WINDOW)

    def add(self, idx: int, t: str) -> None:
        f = self.family
        self.n, self.top = self.n + 1, idx
        self.last.append((idx, t))
        rest = set(words_of(t)) - f.dull
        got = [x for x in (f.live.get(w) or f.look(w) for w in rest) if x]
        if got:
            self.met.append((idx, t, {w for w, _ in got}, {s for _, s in got}))

    def settle(self) -> None:
        f, at = self.family, defaultdict(list)
        for j, (_, _, _, stems) in enumerate(self.met):
            for x in stems:
                at[x].append(j)
        most, held = max(self.n // 4, 64), defaultdict(list)
        for x, js in at.items():
            for i in f.by_stem.get(x, ()):
                held[i].append((x, len(js) <= most))
        for i, stems in held.items():
            words, cue, cue_set, pets, number, _, _ = f.asks[i]
            any_rare = any(rare for _, rare in stems)
            chosen = {x for x, rare in stems if rare or not any_rare} | (_PETS if pets else frozenset())
            near = [(-len(m[2] & words), -len(m[3] & cue_set), j) for j in {j for x in chosen for j in at.get(x, ())} if not (m := self.met[j])[3].isdisjoint(cue_set)]
            best = f.best[i]
            if len(best) == f.k:  # scopes come in order, so what is equal so far comes later
                near = [x for x in near if x[:2] <= best[-1][:2]]
            if len(near) > f.k:
                near.sort()
                near = [x for x in near if x[:2] <= near[f.k - 1][:2]]
            fine = []
            for exact, ov, j in near:
                idx, t = self.met[j][:2]
                e = analysis.episode(t)
                spots = [p for x, p in zip(e[3], e[4], strict=True) if x in cue_set]
                fine.append((exact, ov, len([x for x in e[3] if x not in cue_set and x not in _STOP_VALUES]), min(spots, default=9999), idx, t))
            fine.sort()
            if fine:
                f.keep(i, [(x[0], x[1], x[1] / len(cue), self.name, r + 1, x[4], x[5], cue, number) for r, x in enumerate(fine[: f.k])])
        for i in [i for i in f.open if i not in held]:
            self.by_roots(i)

    def by_roots(self, i: int) -> None:
        roots, number, got = *self.family.asks[i][5:], []
        for idx, t in self.last:
            if idx <= self.top - ROOT_WINDOW:
                continue
            e = analysis.episode(t)
            ov = len(roots.intersection(e[5]))
            if ov:
                inside = lambda w: analysis.root(w) in roots or analysis.root(analysis.canon(w)) in roots
                first = next((p for p, w in enumerate(e[0]) if inside(w)), 9999)
                got.append((-ov, len(e[2]), first, -idx, t, [analysis.stem(w) for w in e[2] if inside(w)]))
        got.sort()
        if got:
            self.family.keep(i, [(0, x[0], x[0] / len(roots), self.name, r + 1, -x[3], x[4], x[5], number) for r, x in enumerate(got[: self.family.k])])
