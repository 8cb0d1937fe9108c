"""Text analysis as Column functions: sentences, words, stems, roots, value candidates.

All are built-in expressions, so they stay in the JVM.  Plural and suffix rules count bytes, the
truncation counts characters; white space is Unicode white space.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicon as lex

_SPACE = r"(?U)\s+"


def _quoted(words) -> str:
    return ", ".join("'" + w.replace("\\", "\\\\").replace("'", "\\'") + "'" for w in words)


def _list(words: list[str]) -> Column:
    return F.expr(f"array({_quoted(words)})")


def _map(pairs: dict[str, str]) -> Column:
    return F.expr(f"map({_quoted([x for kv in pairs.items() for x in kv])})")


def _mapped(w: Column, pairs: dict[str, str]) -> Column:
    """The word's entry in a literal map, else the word."""
    return F.coalesce(F.try_element_at(_map(pairs), w), w)


def bind(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def tokens(text: Column) -> Column:
    """The text's pieces between white space."""
    return F.array_remove(F.split(text, _SPACE), "")


def sentences(text: Column, cap: int = 400) -> Column:
    """Sentences: cut after . ! ? ; before white space, and after every line; trimmed, at most cap."""
    t = F.regexp_replace(text, r"(?U)^\s+|\s+$", "")
    parts = F.transform(F.split(t, r"(?U)(?<=[.!?;])(?=\s)|(?<=\n)"), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", ""))
    kept = F.filter(parts, lambda x: x != "")
    return F.slice(F.when(F.size(kept) == 0, F.array(t)).otherwise(kept), 1, cap)


def clean_word(w: Column) -> Column:
    """A token without surrounding punctuation, lower-cased, without a possessive s."""
    t = F.lower(F.trim(w, F.lit(lex.TRIM_MATCH)))
    return F.regexp_replace(t, "['\u2019]s$", "")


def clip(w: Column) -> Column:
    """A token without surrounding punctuation, case kept."""
    return F.trim(w, F.lit(lex.TRIM_SHOW))


def words(text: Column) -> Column:
    """Distinct clean words in order."""
    return F.array_remove(F.array_distinct(F.transform(tokens(text), clean_word)), "")


def content(text: Column) -> Column:
    """Distinct clean words that carry content."""
    return F.array_except(words(text), _list(lex.STOP))


def stem(w: Column) -> Column:
    """Index key of a word: irregular base, singular, first characters."""

    def cut(x):
        return F.when(F.length(x) >= 8, F.left(x, F.lit(6))).when(F.length(x) >= 5, F.left(x, F.lit(5))).otherwise(x)

    def singular(x):
        n = F.octet_length(x)
        return (
            F.when((n >= 5) & F.endswith(x, F.lit("ies")), F.concat(F.left(x, F.length(x) - 3), F.lit("y")))
            .when((n >= 4) & F.endswith(x, F.lit("s")) & ~F.endswith(x, F.lit("ss")), F.left(x, F.length(x) - 1))
            .otherwise(x)
        )

    return bind(_mapped(w, lex.IRREGULAR), lambda x: bind(singular(x), cut))


def stems(ws: Column) -> Column:
    """Distinct stems of words, sorted."""
    return F.array_sort(F.array_distinct(F.transform(ws, stem)))


def root(w: Column) -> Column:
    """Morphological root: irregular base without the first suffix of the list that fits."""

    def strip(x):
        out = None
        for s in lex.SUFFIXES:
            fits = (F.octet_length(x) >= len(s) + 3) & F.endswith(x, F.lit(s))
            cut = F.left(x, F.length(x) - len(s))
            out = F.when(fits, cut) if out is None else out.when(fits, cut)
        return out.otherwise(x)

    return bind(_mapped(F.lower(F.trim(w, F.lit(lex.TRIM_MATCH))), lex.IRREGULAR), strip)


def canon(w: Column) -> Column:
    """The word that stands for a synonym, plural s tolerated; else the clean word."""

    def look(x):
        m = _map(lex.SYNONYMS)
        bare = F.regexp_replace(x, "s+$", "")
        return F.coalesce(F.try_element_at(m, x), F.when(F.octet_length(bare) >= 3, F.try_element_at(m, bare)), x)

    return bind(clean_word(w), look)


def same_relation(a: Column, b: Column) -> Column:
    """Whether two words name one relation: equal roots, stems, or those of their synonyms."""
    ca, cb = canon(a), canon(b)
    return (root(a) == root(b)) | (stem(clean_word(a)) == stem(clean_word(b))) | (root(ca) == root(cb)) | (stem(ca) == stem(cb))


def cue(text: Column, expand: bool = True) -> Column:
    """Stems that a query looks for; with expand, also those of its synonyms' standing words."""
    c = content(text)
    own = F.transform(c, stem)
    if not expand:
        return F.array_sort(F.array_distinct(own))
    more = F.transform(F.filter(c, lambda w: F.map_contains_key(_map(lex.SYNONYMS), w)), lambda w: stem(F.element_at(_map(lex.SYNONYMS), w)))
    return F.array_sort(F.array_distinct(F.concat(own, more)))


def roots(ws: Column) -> Column:
    """Roots of words and of the words that stand for them."""
    return F.array_sort(F.array_distinct(F.concat(F.transform(ws, root), F.transform(ws, lambda w: root(canon(w))))))


def is_number(w: Column) -> Column:
    return w.rlike("[0-9]") | F.lower(w).isin(lex.NUMBERS)


def is_capital(w: Column) -> Column:
    return w.rlike(r"(?U)^\p{Lu}")


def surprise(w: Column, i: Column) -> Column:
    """How unusual a clipped token at position i looks: digits, capitals inside, length."""
    low = F.lower(w)
    looks = F.when(low.rlike("[0-9]"), 3.0).when(is_capital(w) & (i > 0), 2.0).otherwise(0.0)
    return looks + F.when(F.octet_length(low) >= 7, 0.6).otherwise(0.0)


def semantic_tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits of two bytes or more that carry distributional signal."""
    runs = F.filter(F.split(text, r"[^\p{L}\p{N}]+"), lambda t: F.octet_length(t) >= 2)
    return F.filter(F.transform(runs, F.lower), lambda t: ~F.array_contains(_list(lex.SEMANTIC_STOP), t))


def norm_words(text: Column) -> Column:
    """Lower-cased runs of letters and digits after apostrophes are gone."""
    return F.array_remove(F.split(F.lower(F.replace(text, F.lit("'"), F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def prose_like(text: Column) -> Column:
    """Whether a text has at least two alphanumeric tokens of ordinary length."""
    runs = F.split(text, r"[^\p{L}\p{N}]+")
    return F.size(F.filter(runs, lambda t: F.octet_length(t).between(2, 24))) >= 2


def escape(text: Column) -> Column:
    """Backslash, tab and line feed written as two characters."""
    t = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.replace(F.replace(t, F.lit("\t"), F.lit("\\t")), F.lit("\n"), F.lit("\\n"))


def unescape(text: Column) -> Column:
    """The inverse of escape."""
    parts = F.split(text, r"\\\\", -1)  # between escaped backslashes
    plain = F.transform(parts, lambda p: F.replace(F.replace(p, F.lit("\\t"), F.lit("\t")), F.lit("\\n"), F.lit("\n")))
    return F.array_join(plain, "\\")


def json_escape(text: Column) -> Column:
    """A text as it stands inside a JSON string: quotes, backslashes and control characters escaped."""
    t = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    short = {8: "\\u0008", 9: "\\t", 10: "\\n", 12: "\\u000c", 13: "\\r"}
    for code in range(32):
        t = F.replace(t, F.lit(chr(code)), F.lit(short.get(code, f"\\u{code:04x}")))
    return F.when(text.rlike(r'["\\\x00-\x1F]'), t).otherwise(text)


def url_decode(text: Column) -> Column:
    """Plus signs and percent codes of a query string resolved; null where it isn't well-formed."""
    return F.try_url_decode(text)
