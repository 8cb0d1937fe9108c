"""Verbs over a stored memory: each takes a scope and words and gives a JSON-able answer."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import models, recall, signals, store, turns, vectors
from ..plans.lineage import cut
from ..plans.ops import Memory
from ..sources import packs

FACTS = "scope string, idx long, t string, strength double, key string"
#: Lines that one write takes.
BATCH = 10_000
WRITES = {"observe", "strengthen", "forget", "upsert", "forgetkey", "setvar", "delvar", "stance", "mood", "import", "rewrite", "turn"}


class Session:
    """A memory in a folder; writing verbs save a new version of it when they are done."""

    def __init__(self, spark: SparkSession, folder: str | None = None, max_facts: int = 1_000_000):
        self.spark, self.folder = spark, folder
        facts = models.load(spark, f"{folder}/facts") if folder else None
        self.memory = Memory(facts if facts is not None else spark.createDataFrame([], FACTS), max_facts)

    def run(self, verb: str, scope: str = "", words: str = "", **options):
        """The answer of one verb; KeyError for one that doesn't exist."""
        call = VERBS[verb]
        out = call(self, scope, words, **options)
        if verb in WRITES and self.folder:
            models.save(self.memory.facts, f"{self.folder}/facts")
        return out

    def _rows(self, df: DataFrame) -> list[dict]:
        return [r.asDict(recursive=True) for r in df.collect()]

    def _ask(self, scope: str, words: str) -> DataFrame:
        return self.spark.createDataFrame([(1, scope, words)], "qid long, scope string, query string")

    def _scope(self, scope: str) -> DataFrame:
        return self.spark.createDataFrame([(scope,)], "scope string")

    def _become(self, memory: Memory) -> None:
        self.memory = Memory(cut(memory.facts), memory.max_facts, memory.vectors)

    def _count(self, scope: str) -> int:
        return self.memory.facts.where(F.col("scope") == scope).count()

    def observe(self, scope, words, check=True):
        """Writes words as facts; with check, contradictions with what is held are marked on both sides."""
        before, asked = self._count(scope), self._ask(scope, words)
        marks = self._rows(signals.observe_checked(asked, self.memory.recall(asked, 4))) if check and before else []
        self._become(self.memory.observe(self.spark.createDataFrame([(scope, 0, words)], "scope string, seq long, text string")))
        if marks:
            table = self.spark.createDataFrame([(m["scope"], m["hash"], m["with"]) for m in marks], "scope string, hash string, with string")
            self._become(self.memory.var_set(signals.marks_as_variables(table)))
        return {"wrote": self._count(scope) - before, "contested": len(marks)}

    def capture(self, scope, lines, only=None, skip=None):
        """Writes lines as they come, a batch at a time; those that hold only, and don't hold skip."""
        kept = [line.rstrip("\r\n") for line in lines if (not only or only in line) and not (skip and skip in line)]
        for at in range(0, len(kept), BATCH):
            rows = [(scope, i, line) for i, line in enumerate(kept[at : at + BATCH])]
            self._become(self.memory.observe(self.spark.createDataFrame(rows, "scope string, seq long, text string")))
        if self.folder:
            models.save(self.memory.facts, f"{self.folder}/facts")
        return {"lines": len(kept), "facts": self._count(scope)}

    def learn(self, scope="", words=""):
        """Trains word vectors on what is held; recalls that miss look by meaning from then on."""
        self.memory = self.memory.learn()
        return self._rows(vectors.semantic_totals(self.memory.vectors, vectors.word_counts(self.memory.facts, "t")))[0]

    def neighbors(self, scope, words, k=8):
        """The words nearest to a word, once vectors are learned."""
        if self.memory.vectors is None:
            return []
        table = vectors.dense(self.memory.vectors, ["word"]).withColumnRenamed("word", "id")
        asked = table.where(F.col("id") == words.strip().lower()).withColumnRenamed("id", "qid")
        return sorted(self._rows(vectors.nearest(table, asked, k).select("rank", "id", "cosine")), key=lambda r: r["rank"])

    def get(self, scope, words):
        hit = self.recall(scope, words)
        return hit["value"] if hit else None

    def recall(self, scope, words):
        hits = self._rows(self.memory.recall_one(self._ask(scope, words)))
        return hits[0] if hits else None

    def recall_many(self, scope, words, k=6, across=False):
        return sorted(self._rows(self.memory.recall(self._ask(scope, words), k, across)), key=lambda r: r["rank"])

    def recall_scored(self, scope, words, k=6, across=False):
        hits = self.memory.recall(self._ask(scope, words), k, across)
        return sorted(self._rows(signals.scored(hits, signals.stored_marks(self.memory.facts))), key=lambda r: r["rank"])

    def recall_keyed(self, scope, words, k=6):
        return sorted(self._rows(self.memory.recall_keyed(self._ask(scope, words), k)), key=lambda r: r["rank"])

    def recall_value(self, scope, words):
        rows = self._rows(self.memory.recall_value(self._ask(scope, words)))
        return rows[0]["value"] if rows else None

    def assoc(self, scope, words, k=16, hops=0):
        return sorted(self._rows(self.memory.recall_assoc(self._ask(scope, words), k, hops)), key=lambda r: r["rank"])

    def context(self, scope, words, k=4, before=2, after=3, across=False):
        return sorted(self._rows(self.memory.recall_context(self._ask(scope, words), k, before, after, across)), key=lambda r: r["rank"])

    def chain(self, scope, words):
        """words: a start and relations, parted by bars."""
        start, *path = [w.strip() for w in words.split("|")]
        rows = self.spark.createDataFrame([(1, scope, start, path)], "qid long, scope string, start string, path array<string>")
        return self._rows(self.memory.recall_chain(rows, len(path)))[0]

    def assess(self, scope, words):
        return self._rows(recall.assess(self._ask(scope, words), self.memory.episodes))[0]

    def route(self, scope, words):
        return self._rows(turns.route(recall.assess(self._ask(scope, words), self.memory.episodes)).select("route"))[0]["route"]

    def read(self, scope, words, start=0, limit=100):
        rows = self._rows(store.page(self.memory.facts.where(F.col("scope") == scope), start, limit))
        return rows[0] if rows else {"scope": scope, "total": 0, "start": start, "facts": []}

    def turn(self, scope, words):
        row = self.spark.createDataFrame([(1, scope, words)], "qid long, scope string, text string")
        out = self._rows(self.memory.turn(row))[0]
        wrote = self.observe(scope, words)["wrote"] if out["kind"] == "ack" else 0
        return {"reply": out["reply"], "kind": out["kind"], "wrote": wrote, "facts": self._count(scope)}

    def strengthen(self, scope, words, bump=1.0):
        row = self.spark.createDataFrame([(scope, words, float(bump))], "scope string, match string, bump double")
        touched = self.memory.facts.where((F.col("scope") == scope) & F.contains(F.lower("t"), F.lit(words.lower()))).count()
        self._become(self.memory.strengthen(row))
        return {"strengthened": touched}

    def forget(self, scope, words=""):
        before = self._count(scope)
        self._become(self.memory.forget(words or None, self._scope(scope)))
        left = self._count(scope)
        return {"forgot": before - left, "remaining": left}

    def upsert(self, scope, words, key=""):
        before = self._count(scope)
        self._become(self.memory.upsert(self.spark.createDataFrame([(scope, 0, key, words)], "scope string, seq long, key string, text string")))
        return {"facts": self._count(scope), "new": self._count(scope) > before}

    def forget_key(self, scope, words):
        kept, told = self.memory.forget_key(self.spark.createDataFrame([(scope, words)], "scope string, key string"))
        rows = [r for r in self._rows(told) if r["scope"] == scope]
        self._become(kept)
        return {"forgot": rows[0]["forgot"], "remaining": rows[0]["remaining"]} if rows else {"forgot": 0, "remaining": 0}

    def set_var(self, scope, words):
        """words: a name and a value, parted by the first equals sign."""
        name, value = (w.strip() for w in words.split("=", 1))
        self._become(self.memory.var_set(self.spark.createDataFrame([(f"{scope}::var", 0, name, value)], "scope string, seq long, name string, value string")))
        return "ok"

    def get_var(self, scope, words):
        rows = self._rows(self.memory.var_get(self.spark.createDataFrame([(f"{scope}::var", words)], "scope string, name string")))
        return rows[0]["value"] if rows else None

    def variables(self, scope, words=""):
        own = store.variables(self.memory.facts.where(F.col("scope") == f"{scope}::var"))
        return {r["name"]: r["value"] for r in sorted(self._rows(own), key=lambda r: r["place"])}

    def delete_var(self, scope, words):
        facts, told = store.delete_variables(self.memory.facts, self.spark.createDataFrame([(f"{scope}::var", words)], "scope string, name string"))
        n = self._rows(told)[0]["deleted"]
        self._become(Memory(facts, self.memory.max_facts, self.memory.vectors))
        return n

    def stance(self, scope, words):
        """words: a topic and a feeling, parted by the first colon."""
        topic, feeling = (" ".join(w.split()) for w in words.split(":", 1))
        sub = f"{scope}::stance"
        row = self.spark.createDataFrame([(sub, topic, feeling)], "scope string, topic string, feeling string")
        facts = signals.reinforce(self.memory.facts, row)
        own = store.decay_others(facts.where(F.col("scope") == sub), F.lit(f"{topic}:"), signals.DECAY, signals.FLOOR)
        self._become(Memory(facts.where(F.col("scope") != sub).unionByName(own), self.memory.max_facts, self.memory.vectors))
        return next(v["strength"] for v in self._views(scope) if v["topic"].lower() == topic.lower())

    def _views(self, scope) -> list[dict]:
        own = self.memory.facts.where(F.col("scope") == f"{scope}::stance")
        return self._rows(own.select(F.substring_index("t", ": ", 1).alias("topic"), F.expr("substring(t, instr(t, ': ') + 2)").alias("feeling"), "strength").orderBy(F.desc("strength"), "topic"))

    def stances(self, scope, words=""):
        """Views held, strongest first; with words, those on that topic."""
        return [v for v in self._views(scope) if not words or v["topic"].lower() in words.lower().split() or v["topic"].lower() == words.lower()]

    def mood(self, scope, words=""):
        sub = f"{scope}::affect"
        if words:
            row = self.spark.createDataFrame([(sub, 0, "mood", words.strip())], "scope string, seq long, name string, value string")
            self._become(self.memory.var_set(row))
        rows = self._rows(self.memory.var_get(self.spark.createDataFrame([(sub, "mood")], "scope string, name string")))
        return rows[0]["value"] if rows else None

    def affect(self, scope, words=""):
        moods = self.spark.createDataFrame([(scope, self.mood(scope), words)], "scope string, mood string, asked string")
        views = self.spark.createDataFrame([(scope, v["topic"], v["feeling"], v["strength"]) for v in self._views(scope)], "scope string, topic string, feeling string, strength double")
        return self._rows(signals.directive(moods, views))[0]["directive"]

    def why(self, scope, words):
        views = self.spark.createDataFrame([(scope, v["topic"], v["feeling"], v["strength"]) for v in self._views(scope)], "scope string, topic string, feeling string, strength double")
        rows = self._rows(self.memory.why(self.spark.createDataFrame([(1, scope, words)], "qid long, scope string, topic string"), views))
        return rows[0] if rows else None

    def rewrite(self, scope, words):
        """words: the old text and the new, parted by a bar."""
        old, new = (w.strip() for w in words.split("|", 1))
        row = self.spark.createDataFrame([(scope, old, new)], "scope string, old string, new string")
        self._become(Memory(store.rewrite(self.memory.facts, row), self.memory.max_facts, self.memory.vectors))
        return {"facts": self._count(scope)}

    def stats(self, scope, words=""):
        return {"facts": self._count(scope), "max_facts": self.memory.max_facts}

    def list(self, scope="", words=""):
        return {r["scope"]: r["facts"] for r in sorted(self._rows(store.catalog(self.memory.facts)), key=lambda r: r["scope"])}

    def load_pack(self, scope, words, replace=False):
        pack = packs.import_pack(packs.read_lines(self.spark, os.path.abspath(words)))
        self._become(Memory(packs.import_into(self.memory.facts, pack, replace=replace), self.memory.max_facts, self.memory.vectors))
        return self.list()

    def export(self, scope="", words=""):
        facts = self.memory.facts.where(F.col("scope") == scope) if scope else self.memory.facts
        return "\n".join(r["text"] for r in sorted(self._rows(packs.export_pack(facts)), key=lambda r: r["scope"]))

    def capabilities(self, scope="", words=""):
        """What is served here, and by the host where words names it."""
        held = self.spark.createDataFrame([("recall", "grounded"), ("observe", "grounded"), ("turn", "grounded"), ("fetch", "deferrable"), ("generate", "deferrable")], "name string, kind string")
        return {r["name"]: r["served_by"] for r in self._rows(signals.resolve_capabilities(held, words.split()))}


VERBS = {
    "observe": Session.observe, "get": Session.get, "recall": Session.recall, "recallmany": Session.recall_many, "recallscored": Session.recall_scored,
    "recallkeyed": Session.recall_keyed, "recallvalue": Session.recall_value, "assoc": Session.assoc, "context": Session.context, "chain": Session.chain,
    "assess": Session.assess, "route": Session.route, "read": Session.read, "turn": Session.turn, "strengthen": Session.strengthen, "forget": Session.forget,
    "upsert": Session.upsert, "forgetkey": Session.forget_key, "setvar": Session.set_var, "getvar": Session.get_var, "vars": Session.variables,
    "delvar": Session.delete_var, "stance": Session.stance, "stances": Session.stances, "mood": Session.mood, "affect": Session.affect, "why": Session.why,
    "rewrite": Session.rewrite, "stats": Session.stats, "list": Session.list, "import": Session.load_pack, "export": Session.export, "caps": Session.capabilities,
    "learn": Session.learn, "neighbors": Session.neighbors,
}
