"""Operator 6: personal data by candidate gradient boosting, native DataFrame functions only.

Base detectors (email, ip, card, phone) are exact: leftmost matches, failing ones dropped.  On top,
high-recall generators propose overlapping candidate spans; a small boosted forest over format and
context features scores each; a calibrated threshold per kind selects.  Base spans always stay.

The forest is trained when a query is built, on generated examples whose features come from the
same expressions, with a fixed seed; its thresholds are the lowest that reach the wanted precision
on held-back examples.  Trees become plain CASE expressions.  One pass over the texts, no shuffle.

Positions are code points, ends exclusive.  Null text is empty: no spans.  Possessive quantifiers
keep the matching linear on very long runs; they match what the plain patterns match.
"""

from __future__ import annotations

import functools
import random

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Kinds in the order that breaks equal starts.
KINDS = ["email", "ip", "card", "phone", "secret"]
BASE_KINDS = KINDS[:4]
# The base patterns, each run entered only at its start or where the last match ended.
BASE_PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: High-recall generators: (kind, pattern).  Overlaps are fine.
GENERATORS = [
    ("secret", r"(?<![A-Za-z0-9_+/=-])[A-Za-z0-9_+/=-]{16,}+"),
    ("secret", r"(?i)(?:password|passwd|pwd|secret|token|api[_-]?key|bearer)\s?[:=]\s?[\x22']?[^\s\x22']{6,}+"),
    ("email", r"(?i)(?<![\w.])[\w.+-]{2,64}+\x20?[\[(]at[\])]\x20?[\w-]{2,64}+(?:\x20?[\[(]dot[\])]\x20?\w{2,24}+)+"),
    ("ip", r"(?i)(?<![\w:])[0-9a-f]{1,4}+(?::[0-9a-f]{0,4}+){3,7}+(?![\w:])"),
    ("card", r"(?<![0-9A-Za-z.])[0-9]{4}+(?:[.\x20/_-][0-9]{4}+){3}+(?![0-9A-Za-z.])"),
    ("phone", r"(?<![0-9A-Za-z.+)-])(?:\([0-9]{2,4}+\)\x20?|0[0-9]{1,3}+[\x20/-])[0-9]{3,4}+[\x20-][0-9]{3,5}+(?![0-9A-Za-z.])"),
]
BEFORE, BLOCK = 24, 64


def _bind(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _running(sizes: Column) -> Column:
    """Sums of all elements before each: inside blocks of BLOCK, and over the blocks' totals."""
    add = lambda part: F.aggregate(part, F.lit(0), lambda x, y: x + y)
    blocks = lambda a: F.sequence(F.lit(0), F.floor((F.size(a) - 1) / BLOCK).cast("int"))

    def place(a, totals):
        def inside(b):
            return _bind(
                F.struct(F.slice(a, b * BLOCK + 1, BLOCK).alias("x"), add(F.slice(totals, 1, b)).alias("at")),
                lambda p: F.transform(p["x"], lambda _, i: p["at"] + add(F.slice(p["x"], 1, i))),
            )

        return F.flatten(F.transform(blocks(a), inside))

    return _bind(sizes, lambda a: _bind(F.transform(blocks(a), lambda b: add(F.slice(a, b * BLOCK + 1, BLOCK))), lambda t: place(a, t)))


def spans_of(text: Column, pattern: str, kind: str, context: bool = False) -> Column:
    """array<struct(s, k, e, m)> of a pattern's matches: start, kind number, end, matched text; with
    context also b, the characters before it back to the match before the last.

    Starts are sums of the lengths before, so the work grows with the number of matches, not its square.
    """
    number = F.lit(KINDS.index(kind))
    before = ",b:string" if context else ""
    none = F.array().cast(f"array<struct<s:int,k:int,e:int,m:string{before}>>")

    def spans(x):
        def one(hit, i):
            s = F.get(x["at"], 2 * i + 1)
            own = [s.alias("s"), number.alias("k"), F.get(x["at"], 2 * i + 2).alias("e"), hit.alias("m")]
            return F.struct(*own, F.right(F.concat(F.coalesce(F.get(x["hits"], i - 1), F.lit("")), F.get(x["gaps"], i)), F.lit(BEFORE)).alias("b")) if context else F.struct(*own)

        return F.transform(x["hits"], one)

    def placed(x):
        sizes = F.flatten(F.transform(x["hits"], lambda hit, i: F.array(F.length(F.get(x["gaps"], i)), F.length(hit))))
        return _bind(F.struct(x["hits"].alias("hits"), x["gaps"].alias("gaps"), _running(F.concat(sizes, F.array(F.lit(0)))).alias("at")), spans)

    parts = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hits"), F.split(text, pattern, -1).alias("gaps"))
    return F.when(text.rlike(pattern), _bind(parts, placed)).otherwise(none)


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """True where the digit string passes the Luhn check."""
    n = F.length(digits)

    def part(i):
        d = F.substring(digits, n - i, F.lit(1)).cast("int")
        return F.when(i % 2 == 1, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda a, i: a + part(i)) % 10 == 0


def _valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        plain = lambda p: F.ltrim(p, F.lit("0"))
        return F.forall(F.split(m, r"\."), lambda p: (F.length(plain(p)) <= 3) & (F.lpad(plain(p), 3, "0") <= "255"))
    if kind == "card":
        d = _digits(m)
        return F.when(F.length(d).between(14, 19), luhn(d)).otherwise(False)
    if kind == "phone":
        return F.length(_digits(m)).between(10, 15)
    return F.lit(True)


def base_spans(text: Column, kind: str) -> Column:
    return F.filter(spans_of(text, BASE_PATTERNS[kind], kind), lambda x: _valid(kind, x["m"]))


def features(m: Column, before: Column) -> dict[str, Column]:
    """Yes-or-no features of a candidate's format and of what stands before it."""
    d = _digits(m)
    n = F.length(m)
    letters = F.length(F.regexp_replace(m, "[^A-Za-z]", ""))
    mixed = F.length(F.regexp_replace(m, "([0-9][A-Za-z])|([A-Za-z][0-9])", "")) < n
    cue = lambda words: before.rlike(f"(?i)(?:{words})\\W{{0,12}}$")
    return {
        "long32": n >= 32,
        "long20": n >= 20,
        "digits": F.length(d) > 0,
        "digits5": F.length(d) >= 5,
        "digits20pct": 5 * F.length(d) >= n,
        "no_letters": letters == 0,
        "mixed": mixed,
        "hex": m.rlike(r"^[0-9a-f]{32,}$"),
        "upper_first": m.rlike(r"^[A-Z]{4}"),
        "all_upper": m.rlike(r"^[A-Z0-9]+$") & (letters > 0),
        "has_lower": m.rlike(r"[a-z]"),
        "key_prefix": m.rlike(r"^(?:AKIA|ASIA|ghp_|gho_|sk-|xox[bap]-|eyJ)"),
        "assigned": m.rlike(r"(?i)^(?:password|passwd|pwd|secret|token|api[_-]?key|bearer)\s?[:=]"),
        "cue_secret": cue(r"password|passwd|pwd|secret|token|key|bearer"),
        "cue_contact": cue(r"phone|tel|call|mobile|fax|mail|contact|reach"),
        "cue_card": cue(r"card|visa|account|payment"),
        "cue_ip": cue(r"ip|host|address|server|ipv6"),
        "luhn": F.when(F.length(d).between(14, 19), luhn(d)).otherwise(False),
        "double_colon": m.contains("::"),
        "colons7": F.length(F.regexp_replace(m, "[^:]", "")) == 7,
        "brackets": m.rlike(r"[\[(]"),
        "repeated": m.rlike(r"(.)\1{5}"),
        "cue_code": cue(r"commit|version|issue|isbn|build|rev|id|order"),
    }


def feature_bits(m: Column, before: Column) -> Column:
    total = F.lit(0).cast("int")
    for i, c in enumerate(features(m, before).values()):
        total = total + F.when(c, F.lit(1 << i)).otherwise(F.lit(0))
    return total


def _examples(n: int, seed: int) -> list[tuple[str, str, str, int]]:
    """Generated (kind, text before, candidate, label) examples."""
    rng = random.Random(seed)
    pick = lambda s, k: "".join(rng.choice(s) for _ in range(k))
    low, up, dig, hexa = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "0123456789abcdef"
    filler = lambda: " ".join(pick(low, rng.randint(2, 7)) for _ in range(4)) + " "
    word = lambda k: "".join(rng.choice(["th", "er", "keit", "on", "tion", "lich", "que", "ment", "sch", "en"]) for _ in range(k))

    def luhn_number(good: bool) -> str:
        d = [rng.randint(0, 9) for _ in range(15)]
        s = sum((2 * x - 9 if 2 * x > 9 else 2 * x) if i % 2 == 0 else x for i, x in enumerate(d))
        last = -s % 10
        return "".join(map(str, d)) + str(last if good else (last + rng.randint(1, 9)) % 10)

    group = lambda s, sep: sep.join(s[i : i + 4] for i in range(0, 16, 4))
    makers = [
        ("secret", 1, lambda: (filler(), "AKIA" + pick(up + dig, 16))),
        ("secret", 1, lambda: (filler() + rng.choice(['token = "', "api_key: ", "secret='", "Bearer "]), pick(hexa, rng.choice([32, 40, 64])))),
        ("secret", 1, lambda: (filler(), rng.choice(["password=", "token: ", 'token = "', "api_key=", "pwd:"]) + pick(hexa + up, rng.randint(10, 24)))),
        ("secret", 1, lambda: (filler(), rng.choice(["ghp_", "sk-", "xoxb-"]) + pick(low + up + dig, 30))),
        ("secret", 0, lambda: (filler(), word(rng.randint(4, 9)))),
        ("secret", 0, lambda: (filler(), word(3) + "-" + word(3))),
        ("secret", 0, lambda: (filler(), pick(dig, rng.randint(16, 20)))),
        ("secret", 0, lambda: (filler() + rng.choice(["commit ", "version ", "build "]), pick(hexa, 40))),
        ("secret", 0, lambda: (filler(), rng.choice("=-_") * rng.randint(16, 60))),
        ("secret", 0, lambda: (filler(), word(2).upper() + "_" + word(3).upper())),
        ("secret", 0, lambda: (filler(), rng.choice(["token: ", "secret: ", "key: "]) + word(rng.randint(2, 4)))),
        ("email", 1, lambda: (filler() + rng.choice(["", "mail "]), f"{pick(low, 6)} [at] {pick(low, 7)} [dot] com")),
        ("email", 0, lambda: (filler(), f"{pick(low, 4)} (at) {pick(dig, 3)} (dot) {pick(dig, 2)}")),
        ("ip", 1, lambda: (filler() + rng.choice(["", "ip ", "host "]), ":".join(pick(hexa, 4) for _ in range(8)))),
        ("ip", 1, lambda: (filler(), f"{pick(hexa, 4)}:{pick(hexa, 3)}::{pick(hexa, 4)}:{pick(hexa, 2)}")),
        ("ip", 0, lambda: (filler(), ":".join(pick(dig, 2) for _ in range(rng.randint(4, 6))))),
        ("card", 1, lambda: (filler() + rng.choice(["", "card "]), group(luhn_number(True), rng.choice("./_")))),
        ("card", 0, lambda: (filler(), group(luhn_number(False), rng.choice("./_- ")))),
        ("phone", 1, lambda: (filler() + rng.choice(["phone ", "tel: ", "call ", "mobile "]), f"({pick(dig, 3)}) {pick(dig, 3)}-{pick(dig, 4)}")),
        ("phone", 1, lambda: (filler(), f"({pick(dig, 3)}) {pick(dig, 3)}-{pick(dig, 4)}")),
        ("phone", 0, lambda: (filler() + rng.choice(["order ", "id ", "isbn "]), f"0{pick(dig, 2)}-{pick(dig, 3)}-{pick(dig, 4)}")),
        ("phone", 0, lambda: (filler(), f"0{pick(dig, 2)} {pick(dig, 3)} {pick(dig, 3)}")),
    ]
    return [(k, *f(), y) for k, y, f in (makers[i % len(makers)] for i in range(n))]


def boost(rows: list[tuple[int, int, int]], rounds: int = 24, rate: float = 0.4, min_weight: float = 1.0):
    """Gradient-boosted trees of depth two on feature bits: [(bit, (bit, a, b), (bit, c, d))].

    rows: (bits, label, count).  Leaves are Newton steps of the logistic loss.
    """
    import math

    n_bits = 1 + max((b for b, _, _ in rows), default=1).bit_length()
    margin = [0.0] * len(rows)
    trees = []

    def leaf(idx):
        g = sum(grad[i] for i in idx)
        h = sum(hess[i] for i in idx)
        return rate * g / (h + min_weight), g * g / (h + min_weight)

    def best_split(idx):
        best = (-1.0, 0, None, None)
        for bit in range(n_bits):
            on = [i for i in idx if rows[i][0] >> bit & 1]
            off = [i for i in idx if not rows[i][0] >> bit & 1]
            gain = leaf(on)[1] + leaf(off)[1]
            if gain > best[0] + 1e-12:
                best = (gain, bit, on, off)
        return best

    for _ in range(rounds):
        p = [1 / (1 + math.exp(-m)) for m in margin]
        grad = [(y - q) * c for (_, y, c), q in zip(rows, p, strict=True)]
        hess = [q * (1 - q) * c for (_, _, c), q in zip(rows, p, strict=True)]
        _, bit, on, off = best_split(range(len(rows)))
        sides = []
        for idx in (on, off):
            _, b2, on2, off2 = best_split(idx) if idx else (0, 0, [], [])
            sides.append((b2, leaf(on2)[0], leaf(off2)[0]))
            for i in on2:
                margin[i] += sides[-1][1]
            for i in off2:
                margin[i] += sides[-1][2]
        trees.append((bit, *sides))
    return trees


def margin_of(trees, bits: int) -> float:
    total = 0.0
    for bit, on, off in trees:
        b2, a, b = on if bits >> bit & 1 else off
        total += a if bits >> b2 & 1 else b
    return total


def margin_column(trees, bits: Column) -> Column:
    has = lambda bit: bits.bitwiseAND(F.lit(1 << bit)) != 0
    total = F.lit(0.0)
    for bit, (b1, a1, z1), (b2, a2, z2) in trees:
        total = total + F.when(has(bit), F.when(has(b1), F.lit(a1)).otherwise(F.lit(z1))).otherwise(F.when(has(b2), F.lit(a2)).otherwise(F.lit(z2)))
    return total


@functools.lru_cache(maxsize=4)
def _model(spark, n: int = 1760, seed: int = 11, precision: float = 0.99):
    """Per kind: the trees and the lowest margin that reaches the precision on held-back examples."""
    ex = _examples(n, seed)
    quote = lambda s: "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"
    values = ", ".join(f"({i}, {quote(b)}, {quote(m)})" for i, (_, b, m, _) in enumerate(ex))
    table = spark.sql(f"SELECT * FROM VALUES {values} AS t(i, b, m)")
    bits = {r["i"]: r["x"] for r in table.select("i", feature_bits(F.col("m"), F.right("b", F.lit(BEFORE))).alias("x")).collect()}
    out = {}
    for kind in KINDS:
        own = [(bits[i], y, i) for i, (k, _, _, y) in enumerate(ex) if k == kind]
        rng = random.Random(seed)
        rng.shuffle(own)
        half = len(own) // 2
        counts: dict[tuple[int, int], int] = {}
        for x, y, _ in own[:half]:
            counts[x, y] = counts.get((x, y), 0) + 1
        trees = boost([(x, y, c) for (x, y), c in sorted(counts.items())])
        held = sorted(((margin_of(trees, x), y) for x, y, _ in own[half:]), reverse=True)
        limit, good, seen = float("inf"), 0, 0
        for i, (m, y) in enumerate(held):
            good, seen = good + y, seen + 1
            last = i + 1 == len(held) or held[i + 1][0] < m
            if last and good >= precision * seen and m > 0:
                limit = m
        out[kind] = (trees, limit if limit < float("inf") else 1e9)
    return out


def candidate_spans(text: Column, model) -> Column:
    """Spans that the forest selects; one list for each generator, joined."""
    def chosen(kind, pattern):
        trees, limit = model[kind]

        def passes(x):
            return _bind(feature_bits(x["m"], x["b"]), lambda b: margin_column(trees, b)) >= limit

        return F.filter(spans_of(text, pattern, kind, context=True), passes)

    return F.concat(*[chosen(kind, pattern) for kind, pattern in GENERATORS])


def _join(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["k"] + 1), x["s"].cast("string"), x["e"].cast("string"))), ",")


def find(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Counts, digest and spans of every row, with the span array (found) and any columns in keep."""
    model = _model(df.sparkSession)
    keep = keep or []
    rows = df.select(F.col(id_col).alias("doc_id"), *keep, F.coalesce(F.col(text_col), F.lit("")).alias("_t"))
    rows = rows.withColumns({f"_{k}": base_spans(F.col("_t"), k) for k in BASE_KINDS} | {"_more": candidate_spans(F.col("_t"), model)})
    drop_m = lambda a: F.transform(a, lambda x: F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e")))
    rows = rows.withColumn("_base", F.sort_array(drop_m(F.concat(*[F.col(f"_{k}") for k in BASE_KINDS]))))
    rows = rows.withColumn("found", F.sort_array(F.array_distinct(F.concat("_base", drop_m(F.col("_more"))))))
    return rows.select(
        "doc_id",
        *keep,
        *[F.size(f"_{k}").cast("long").alias(f"n_{k}") for k in BASE_KINDS],
        F.sha2(_join(F.col("_base")), 256).alias("base_sha256"),
        _join(F.col("found")).alias("spans"),
        "found",
        F.col("_t").alias("clean_text"),
    )


def redacted(text: Column, found: Column) -> Column:
    """The text with every span replaced by its kind in brackets; overlapping spans become one."""
    names = F.array(*[F.lit(f"[{k}]") for k in KINDS])
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc, x):
        fresh = x["s"] >= acc["at"]
        piece = F.array(F.substring(text, acc["at"] + 1, x["s"] - acc["at"]), F.element_at(names, x["k"] + 1))
        return F.struct(F.greatest(acc["at"], x["e"]).alias("at"), F.when(fresh, F.concat(acc["out"], piece)).otherwise(acc["out"]).alias("out"))

    whole = F.aggregate(found, zero, step, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(text, acc["at"] + 1, F.length(text))))
    return F.when(F.size(found) > 0, whole).otherwise(text)


def query(spark, sf_dir: str) -> DataFrame:
    from .textblocks import read_table

    return find(read_table(spark, sf_dir, "documents")).drop("found", "clean_text")
