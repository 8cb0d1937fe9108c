"""The op vocabulary over tables: one entry per op, limits clamped in one place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import graph, recall, semantic, signals, store, turns, vectors
from ..operators.encode import encode
from ..operators.index import Index
from .lineage import cut

# Limits of each op's arguments.
LIMITS = {"recall_k": (1, 50), "assoc_k": (1, 64), "context_k": (1, 16), "around": (0, 16), "page": (1, 500), "bump": (0.05, 4.0)}


def clamp(name: str, x):
    lo, hi = LIMITS[name]
    return min(max(x, lo), hi)


class Memory:
    """Facts tables with every op; ops that write return a new Memory."""

    def __init__(self, facts: DataFrame, max_facts: int = 1_000_000, vectors: DataFrame | None = None):
        self.facts, self.max_facts, self.vectors = facts, max_facts, vectors
        self._index = self._embedded = None

    @property
    def index(self) -> Index:
        """The index of the facts, encoded once for all reads."""
        if self._index is None:
            self._index = Index.of(cut(encode(self.facts)))
        return self._index

    @property
    def episodes(self) -> DataFrame:
        return self.index.episodes

    @property
    def embedded(self) -> DataFrame:
        """The facts' vectors, worked out once; needs word vectors."""
        if self._embedded is None:
            self._embedded = cut(semantic.embedded(self.facts, self.vectors, ["scope", "idx"], "t"))
        return self._embedded

    def learn(self) -> Memory:
        """The same facts with word vectors trained on those that read like prose."""
        prose = self.facts.where(T.prose_like(F.col("t")) & ~F.contains("scope", F.lit("::")) & F.col("key").isNull())
        return Memory(self.facts, self.max_facts, cut(vectors.train(prose.select(F.col("t").alias("text")))))

    def apply(self, op: str, *args, **kw):
        return getattr(self, op)(*args, **kw)

    # writes
    def observe(self, messages: DataFrame) -> Memory:
        return Memory(store.drain(store.observe_durable(messages, self.facts), self.max_facts)[0], self.max_facts, self.vectors)

    def observe_bulk(self, messages: DataFrame) -> Memory:
        return Memory(store.drain(store.append(self.facts, store.observe(messages)), self.max_facts)[0], self.max_facts, self.vectors)

    observe_many = observe

    def var_set(self, assignments: DataFrame) -> Memory:
        return Memory(store.set_variables(self.facts, assignments), self.max_facts, self.vectors)

    def upsert(self, rows: DataFrame) -> Memory:
        return Memory(store.upsert(self.facts, rows), self.max_facts, self.vectors)

    def strengthen(self, matches: DataFrame) -> Memory:
        return Memory(store.strengthen(self.facts, matches), self.max_facts, self.vectors)

    def forget(self, match: str | None = None, scopes: DataFrame | None = None) -> Memory:
        """Without the facts that hold a match, of all scopes or some; without a match the scopes go whole,
        typed sub-scopes too."""
        if match is None:
            return Memory(store.wipe(self.facts, scopes) if scopes is not None else self.facts.limit(0), self.max_facts, self.vectors)
        if scopes is None:
            return Memory(store.forget(self.facts, F.lit(match)), self.max_facts, self.vectors)
        own = self.facts.join(scopes, "scope", "left_semi")
        rest = self.facts.join(scopes, "scope", "left_anti").select(store.FACT)
        return Memory(rest.unionByName(store.forget(own, F.lit(match)).select(store.FACT)), self.max_facts, self.vectors)

    def forget_key(self, keys: DataFrame) -> tuple[Memory, DataFrame]:
        left = store.renumber(self.facts.join(keys, ["scope", "key"], "left_anti").select(store.FACT))
        return Memory(left, self.max_facts, self.vectors), store.forget_key(self.facts, keys)

    # reads
    def _asked(self, queries: DataFrame) -> DataFrame:
        return semantic.embedded(queries, self.vectors, ["qid", "scope"], "query")

    def recall(self, queries: DataFrame, k: int = 8, across: bool = False, by_meaning: bool = False) -> DataFrame:
        """The k best facts: over a scope's documents, or by word hits and meaning together, or by cue."""
        k = clamp("recall_k", k)
        if across:
            return recall.recall_across(queries, self.episodes, k)
        if not by_meaning or self.vectors is None:
            return recall.recall_many(queries, self.index, k)
        asked = cut(self._asked(queries))
        hits = semantic.recall_blended(queries, self.facts, asked, self.embedded, k).join(self.episodes.select("scope", "idx", "t", "v"), ["scope", "idx"])
        cols = {"fact": F.col("t"), "value": F.col("v"), "coverage": F.col("score"), "overlap": F.lit(0), "exact": F.lit(0), "echo": F.lit(False)}
        plain = queries.join(asked.select("qid", "scope"), ["qid", "scope"], "left_anti")  # no signal: by cue
        return hits.withColumns(cols).select(recall.HIT).unionByName(recall.recall_many(plain, self.index, k))

    def recall_one(self, queries: DataFrame) -> DataFrame:
        """The best fact by cue; with word vectors, a miss is looked for by meaning."""
        if self.vectors is None:
            return recall.recall(queries, self.index)
        return semantic.recall_durable(queries, self.index, self._asked(queries), self.embedded)

    def recall_value(self, queries: DataFrame) -> DataFrame:
        """Values from the scope itself, else from its documents."""
        return recall.recall_value(queries, self.episodes)

    def recall_scored(self, queries: DataFrame, marks: DataFrame, k: int = 6, across: bool = False, by_meaning: bool = False) -> DataFrame:
        return signals.scored(self.recall(queries, k, across, by_meaning), marks)

    def recall_keyed(self, queries: DataFrame, k: int = 6) -> DataFrame:
        return recall.keyed_hits(self.recall(queries, k), self.facts)

    def why(self, topics: DataFrame, views: DataFrame) -> DataFrame:
        """Views on topics (qid, scope, topic) with three facts each as evidence."""
        return signals.why(topics, views, self.recall(topics.select("qid", "scope", F.col("topic").alias("query")), 3))

    def recall_assoc(self, queries: DataFrame, k: int = 16, hops: int = 0) -> DataFrame:
        return graph.spread(queries, self.index, clamp("assoc_k", k), hops)

    def recall_context(self, queries: DataFrame, k: int = 4, before: int = 2, after: int = 3, across: bool = False) -> DataFrame:
        return recall.recall_context(queries, self.episodes, self.facts, clamp("context_k", k), clamp("around", before), clamp("around", after), across)

    def recall_chain(self, starts: DataFrame, hops: int) -> DataFrame:
        return recall.chain(starts, self.index, hops)

    def read_page(self, start: int, limit: int) -> DataFrame:
        return store.page(self.facts, start, clamp("page", limit))

    def variables(self) -> DataFrame:
        return store.variables(self.facts)

    def var_get(self, names: DataFrame) -> DataFrame:
        return store.get_variables(self.facts, names)

    def stance(self, notes: DataFrame, persona: dict | None = None) -> DataFrame:
        return signals.stances(notes, persona)

    def mood(self, moods: DataFrame) -> DataFrame:
        return moods.groupBy("scope").agg(F.max_by("mood", "seq").alias("mood"))

    def affect(self, moods: DataFrame, views: DataFrame, persona: dict | None = None) -> DataFrame:
        return signals.directive(moods, views, persona)

    def turn(self, messages: DataFrame) -> DataFrame:
        return turns.answer(messages, self.episodes)

    def stats(self) -> DataFrame:
        return store.stats(self.facts, self.max_facts)

    def list(self) -> DataFrame:
        return store.catalog(self.facts)
