"""DuckDB SQL for the registered queries: an independent restatement over the same tables.

The text rules are written as SQL expressions in DuckDB's own functions; queries are common table
expressions over them.  Nothing here runs in Spark.
"""

from __future__ import annotations

from ..functions import lexicon as lex
from ..operators import turns as rules


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _set(words) -> str:
    return "[" + ", ".join(_q(w) for w in words) + "]"


def _in(x: str, words) -> str:
    return f"{x} IN (" + ", ".join(_q(w) for w in words) + ")"


def _map(x: str, pairs: dict[str, str]) -> str:
    return f"CASE {x} " + " ".join(f"WHEN {_q(k)} THEN {_q(v)}" for k, v in pairs.items()) + f" ELSE {x} END"


def _let(value: str, name: str, body: str) -> str:
    return f"list_transform([{value}], lambda {name}: {body})[1]"


WS = r"\s"


def tokens(t: str) -> str:
    return rf"list_filter(regexp_split_to_array({t}, '\s+'), lambda k: k <> '')"


def trimmed(t: str) -> str:
    return rf"regexp_replace({t}, '^\s+|\s+$', '', 'g')"


def sentences(t: str) -> str:
    cut = rf"regexp_replace(regexp_replace({trimmed(t)}, '([.!?;])(\s)', '\1' || chr(1) || '\2', 'g'), chr(10), chr(10) || chr(1), 'g')"
    parts = f"list_filter(list_transform(string_split({cut}, chr(1)), lambda p: {trimmed('p')}), lambda p: p <> '')"
    return f"(CASE WHEN len({parts}) = 0 THEN [{trimmed(t)}] ELSE {parts} END)[1:400]"


def clean(w: str) -> str:
    return f"regexp_replace(lower(trim({w}, {_q(lex.TRIM_MATCH)})), '[''’]s$', '')"


def clip(w: str) -> str:
    return f"trim({w}, {_q(lex.TRIM_SHOW)})"


def stem(w: str) -> str:
    sing = "CASE WHEN strlen(a) >= 5 AND ends_with(a, 'ies') THEN left(a, length(a) - 3) || 'y' WHEN strlen(a) >= 4 AND ends_with(a, 's') AND NOT ends_with(a, 'ss') THEN left(a, length(a) - 1) ELSE a END"
    cut = "CASE WHEN length(b) >= 8 THEN left(b, 6) WHEN length(b) >= 5 THEN left(b, 5) ELSE b END"
    return _let(_map(w, lex.IRREGULAR), "a", _let(sing, "b", cut))


def root(w: str) -> str:
    strip = "CASE " + " ".join(f"WHEN strlen(c) >= {len(s) + 3} AND ends_with(c, {_q(s)}) THEN left(c, length(c) - {len(s)})" for s in lex.SUFFIXES) + " ELSE c END"
    return _let(f"lower(trim({w}, {_q(lex.TRIM_MATCH)}))", "r", _let(_map("r", lex.IRREGULAR), "c", strip))


def canon(w: str) -> str:
    look = f"CASE WHEN {_in('d', lex.SYNONYMS)} THEN {_map('d', lex.SYNONYMS)} WHEN strlen(rtrim(d, 's')) >= 3 AND {_in('rtrim(d, ' + _q('s') + ')', lex.SYNONYMS)} THEN {_map('rtrim(d, ' + _q('s') + ')', lex.SYNONYMS)} ELSE d END"
    return _let(clean(w), "d", look)


def content(t: str) -> str:
    return f"list_sort(list_distinct(list_filter(list_transform({tokens(t)}, lambda w: {clean('w')}), lambda w: w <> '' AND NOT ({_in('w', lex.STOP)}))))"


def cue(t: str, expand: bool = True) -> str:
    own = f"list_transform({content(t)}, lambda w: {stem('w')})"
    if not expand:
        return f"list_sort(list_distinct({own}))"
    more = f"list_transform(list_filter({content(t)}, lambda w: {_in('w', lex.SYNONYMS)}), lambda w: {stem('(' + _map('w', lex.SYNONYMS) + ')')})"
    return f"list_sort(list_distinct(list_concat({own}, {more})))"


def semantic(t: str) -> str:
    runs = rf"list_filter(regexp_split_to_array({t}, '[^\p{{L}}\p{{N}}]+'), lambda x: strlen(x) >= 2)"
    return f"list_filter(list_transform({runs}, lambda x: lower(x)), lambda x: NOT ({_in('x', lex.SEMANTIC_STOP)}))"


def norm_words(t: str) -> str:
    return rf"list_filter(regexp_split_to_array(lower(replace({t}, '''', '')), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')"


def fnv(x: str, basis: int) -> str:
    """A string's 64-bit hash as an unsigned 128-bit number: one step a byte."""
    digit = lambda k: f"(strpos('0123456789ABCDEF', substr(hex({x}), 2 * i + {k}, 1)) - 1)"
    byte = f"list_transform(range(0, strlen({x})), lambda i: ({digit(1)} * 16 + {digit(2)})::UHUGEINT)"
    return f"list_reduce(list_concat([{basis}::UHUGEINT], {byte}), lambda h, b: (xor(h, b) * 1099511628211::UHUGEINT) % 18446744073709551616::UHUGEINT)"


def fact_key(words: str) -> str:
    return f"lpad(lower(hex({fnv(words, 0xCBF29CE484222325)}::UBIGINT)), 16, '0')"


CAPITAL = r"regexp_matches({0}, '^\p{{Lu}}')"


def number(w: str) -> str:
    return f"(regexp_matches({w}, '[0-9]') OR {_in(f'lower({w})', lex.NUMBERS)})"


MESSAGES = "msg AS (SELECT conv_id::VARCHAR AS scope, turn AS seq, role, text FROM conversations)"
SENT = f"{MESSAGES}, sen0 AS (SELECT scope, seq, {sentences('text')} AS l FROM msg), sen AS (SELECT scope, seq, generate_subscripts(l, 1) - 1 AS pos, unnest(l) AS t FROM sen0)"


def encoded(source: str, name: str = "enc") -> str:
    """CTEs that encode rows (scope, o1, o2, t) of a source: rows that hold a fact, with idx."""
    blocked = sorted(set(lex.STOP) | set(lex.STOP_VALUES))
    cap = CAPITAL.format("w")
    return f"""
{name}_a AS (SELECT scope, o1, o2, t, {trimmed('t')} AS u, {tokens(trimmed('t'))} AS tok FROM {source}),
{name}_b AS (SELECT *, list_transform(tok, lambda w: {clean('w')}) AS cw, list_transform(tok, lambda w: {clip('w')}) AS cl FROM {name}_a),
{name}_c AS (SELECT *, list_sort(list_distinct(list_filter(cw, lambda w: w <> '' AND NOT ({_in('w', lex.STOP)})))) AS raw FROM {name}_b),
{name}_d AS (SELECT * FROM {name}_c WHERE len(raw) > 0 AND (len(tok) >= 3 OR len(list_filter(raw, lambda w: regexp_matches(w, '[0-9]'))) > 0 OR contains(u, ':'))),
{name}_e AS (SELECT scope, o1, o2, generate_subscripts(cl, 1) - 1 AS i, unnest(cl) AS w FROM {name}_d),
{name}_f AS (SELECT scope, o1, o2, i, w,
    (CASE WHEN regexp_matches(lower(w), '[0-9]') THEN 3.0::DOUBLE WHEN {cap} AND i > 0 THEN 2.0::DOUBLE ELSE 0.0::DOUBLE END)
    + (CASE WHEN strlen(lower(w)) >= 7 THEN 0.6::DOUBLE ELSE 0.0::DOUBLE END) + 0.15::DOUBLE * i::DOUBLE AS sc
  FROM {name}_e WHERE lower(w) <> '' AND NOT ({_in('lower(w)', blocked)}) AND regexp_matches(lower(w), '[\\p{{L}}\\p{{N}}]') AND (strlen(lower(w)) >= 3 OR regexp_matches(lower(w), '^[0-9]+$'))),
{name}_g AS (SELECT *, row_number() OVER (PARTITION BY scope, o1, o2 ORDER BY sc DESC, i) AS r FROM {name}_f),
{name}_h AS (SELECT *, CASE WHEN r <= 5 THEN 0 ELSE row_number() OVER (PARTITION BY scope, o1, o2, r <= 5 ORDER BY r) END AS x FROM {name}_g WHERE r <= 5 OR {number('w')} OR {cap}),
{name}_i AS (SELECT scope, o1, o2, list(w ORDER BY r) AS c FROM {name}_h WHERE x <= 5 GROUP BY scope, o1, o2),
{name} AS (SELECT d.scope, row_number() OVER (PARTITION BY d.scope ORDER BY d.o1, d.o2) - 1 AS idx, d.o1, d.o2, d.t, d.raw, c, d.cw, d.cl,
    list_sort(list_distinct(list_transform(d.raw, lambda w: {stem('w')}))) AS s,
    list_transform(cw, lambda w: {stem('w')}) AS ts,
    coalesce(list_transform(list_filter(cw, lambda w: w <> '' AND NOT ({_in('w', lex.STOP)}) AND NOT ({_in('w', lex.FILLERS)})), lambda w: {stem('w')})[1], '') AS head,
    list_has_any(cw, ['my', 'i', 'im', 'mine']) AND NOT list_has_any(cw, ['her', 'his', 'its', 'their', 'your']) AS selfish
  FROM {name}_d d JOIN {name}_i USING (scope, o1, o2))"""


FACT = f"{SENT}, src AS (SELECT scope, seq AS o1, pos AS o2, t FROM sen WHERE NOT contains(t, '?')), {encoded('src')}"
SCORED_COLUMNS = """
    len(list_intersect(cue, s)) AS ov, len(list_intersect(q, raw)) AS exact,
    -len(list_filter(s, lambda x: NOT list_contains(cue, x) AND NOT list_contains({sv}, x))) AS spec,
    coalesce(list_min(list_transform(list_intersect(cue, s), lambda x: list_position(ts, x) - 1)), 9999) AS first_cue,
    list_has_any(s, {pets}) AS es_pet,
    len(list_filter(s, lambda x: list_contains({rel}, x) AND NOT list_contains(cue, x))) > 0 AS loose_fact,
    len(list_filter(cue, lambda x: list_contains({rel}, x) AND NOT list_contains(s, x))) > 0 AS loose_cue
""".format(sv=_set(lex.STOP_VALUE_STEMS), pets=_set(lex.PET_STEMS), rel=_set(lex.RELATION_STEMS))


def recall(queries: str, enc: str = "enc", expand: bool = True) -> str:
    """CTEs cues, gate, cand and sc over a CTE of queries (qid, scope, query) and encoded facts."""
    return f"""
cues AS (SELECT qid, scope, {content('query')} AS q, {cue('query', expand)} AS cue FROM {queries}),
kue AS (SELECT *, list_contains(cue, 'pet') OR list_contains(cue, 'animal') AS petq, list_contains(cue, 'name') AND NOT list_has_any(cue, {_set(lex.RELATION_STEMS)}) AS nameq FROM cues WHERE len(q) > 0),
post AS (SELECT scope, idx, unnest(s) AS stem FROM {enc}),
dfs AS (SELECT scope, stem, count(*) AS df FROM post GROUP BY ALL),
siz AS (SELECT scope, count(*) AS n FROM {enc} GROUP BY ALL),
cs AS (SELECT qid, scope, unnest(cue) AS stem FROM kue),
gt AS (SELECT cs.*, df <= greatest(floor(n * 0.25), 64) AS rare FROM cs JOIN dfs USING (scope, stem) JOIN siz USING (scope)),
ga AS (SELECT *, bool_or(rare) OVER (PARTITION BY qid, scope) AS anyr FROM gt),
gc AS (SELECT qid, scope, stem FROM ga WHERE rare OR NOT anyr UNION SELECT qid, scope, unnest({_set(lex.PET_STEMS)}) FROM kue WHERE petq),
cand AS (SELECT DISTINCT qid, scope, idx FROM gc JOIN post USING (scope, stem)),
sc AS (SELECT qid, scope, idx, t, cue, petq, nameq AND selfish AND list_contains(s, 'name') AS selfp, list_contains(cue, head) AS subj, {SCORED_COLUMNS}
  FROM cand JOIN kue USING (qid, scope) JOIN {enc} USING (scope, idx))"""


def root_scan(asked: str, k: int, tag: str = "") -> str:
    """CTE rs<tag>: hits by roots for a CTE of (qid, scope) that kue holds."""
    both = lambda ws: f"list_distinct(list_concat(list_transform({ws}, lambda w: {root('w')}), list_transform({ws}, lambda w: {root('(' + canon('w') + ')')})))"
    inside = f"list_contains(roots, {root('w')}) OR list_contains(roots, {root('(' + canon('w') + ')')})"
    return f"""
rq{tag} AS (SELECT qid, scope, {both('q')} AS roots FROM kue JOIN {asked} USING (qid, scope)),
re{tag} AS (SELECT *, row_number() OVER (PARTITION BY scope ORDER BY idx DESC) AS back FROM enc),
rf{tag} AS (SELECT scope, idx, t, raw, unnest({both('raw')}) AS root FROM re{tag} WHERE back <= 4000),
rr{tag} AS (SELECT qid, scope, unnest(roots) AS root FROM rq{tag}),
rh{tag} AS (SELECT qid, scope, idx, any_value(t) AS t, any_value(raw) AS raw, count(*) AS ov FROM rr{tag} JOIN rf{tag} USING (scope, root) GROUP BY qid, scope, idx),
rp{tag} AS (SELECT h.*, roots, coalesce(list_min(list_filter(list_transform({tokens('t')}, lambda w, i: CASE WHEN {inside} THEN i - 1 ELSE NULL END), lambda i: i IS NOT NULL)), 9999) AS fp FROM rh{tag} h JOIN rq{tag} USING (qid, scope)),
rs{tag} AS (SELECT *, row_number() OVER (PARTITION BY qid, scope ORDER BY ov DESC, len(raw), fp, idx DESC) AS rank, ov / len(roots) AS coverage FROM rp{tag} QUALIFY rank <= {k})"""


LAST = "qs AS (SELECT scope::BIGINT AS qid, scope, arg_max(t, idx) AS query FROM enc GROUP BY scope)"
TOP1 = f"""
w1 AS (SELECT *, CASE WHEN ov < 1 AND petq AND es_pet THEN 1 ELSE ov END AS overlap FROM sc),
w2 AS (SELECT *, row_number() OVER (PARTITION BY qid, scope ORDER BY exact DESC, overlap DESC, selfp DESC, subj DESC, spec DESC, first_cue, idx DESC) AS r
  FROM w1 WHERE overlap >= 1 AND (NOT loose_fact OR (petq AND es_pet)) AND (NOT loose_cue OR (petq AND es_pet))),
w3 AS (SELECT *, CASE WHEN petq AND es_pet THEN 1.0 ELSE ov / len(cue) END AS coverage FROM w2 WHERE r = 1),
need AS (SELECT qid, scope FROM kue EXCEPT SELECT qid, scope FROM w3 WHERE NOT (ov < len(cue) AND loose_cue)),
{root_scan('need', 1, '1')},
better AS (SELECT r.qid, r.scope, r.t, r.idx, r.coverage, r.ov AS overlap, 0 AS exact FROM rs1 r LEFT JOIN w3 USING (qid, scope) WHERE w3.ov IS NULL OR r.ov > w3.ov),
top1 AS (SELECT qid, scope, t AS fact, idx, coverage, overlap, exact FROM w3 WHERE (qid, scope) NOT IN (SELECT (qid, scope) FROM better) UNION ALL SELECT qid, scope, t, idx, coverage, overlap, exact FROM better)"""


def many(k: int) -> str:
    return f"""
m1 AS (SELECT *, row_number() OVER (PARTITION BY qid, scope ORDER BY exact DESC, ov DESC, spec DESC, first_cue, idx) AS rank FROM sc WHERE ov >= 1 QUALIFY rank <= {k}),
miss AS (SELECT qid, scope FROM kue EXCEPT SELECT qid, scope FROM m1),
{root_scan('miss', k)},
hits AS (SELECT qid, scope, rank, t AS fact, idx, ov / len(cue) AS coverage, ov AS overlap, exact FROM m1 UNION ALL SELECT qid, scope, rank, t, idx, coverage, ov, 0 FROM rs)"""


WITH_RECALL = f"WITH {FACT}, {LAST}, {recall('qs')}"
EVK = "ek AS (SELECT user_id::VARCHAR AS scope, event_id AS seq, event_type AS key, 'the last ' || event_type || ' value is ' || round(value, 2)::DECIMAL(18,2)::VARCHAR AS t FROM events), el AS (SELECT *, row_number() OVER (PARTITION BY scope, key ORDER BY seq DESC) AS r FROM ek)"
ROUNDS = "rd AS (SELECT event_id AS n, event_type AS class, value / 100 - 0.5 AS delta FROM events)"
TRUST = f"""RECURSIVE {ROUNDS}, sq AS (SELECT *, row_number() OVER (PARTITION BY class ORDER BY n) AS i FROM rd),
fold(class, i, w) AS (
  SELECT DISTINCT class, 0::BIGINT, 1.0::DOUBLE FROM sq
  UNION ALL
  SELECT f.class, s.i, least(greatest(m.x + (1.0 - m.x) * 0.01, 0.05), 8.0) FROM fold f JOIN sq s ON s.class = f.class AND s.i = f.i + 1,
    LATERAL (SELECT CASE WHEN s.delta > 0 THEN f.w * (1 + 0.25 * least(s.delta, 1.0)) WHEN s.delta < 0 THEN f.w * (1 - 0.25 * least(-s.delta, 1.0)) ELSE f.w * 0.97 END AS x) m
), ledger AS (SELECT class, arg_max(w, i) AS weight FROM fold GROUP BY class)"""


def stance(bump: float, decay: float, floor: float) -> str:
    """Every topic's strength by a fold over all statements of its scope."""
    return f"""RECURSIVE nt AS (SELECT user_id::VARCHAR AS scope, event_id AS seq, event_type AS topic, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events),
tp AS (SELECT scope, topic, min(i) AS first FROM nt GROUP BY ALL),
fold(scope, topic, i, s) AS (
  SELECT scope, topic, first, {bump}::DOUBLE FROM tp
  UNION ALL
  SELECT f.scope, f.topic, n.i, CASE WHEN n.topic = f.topic THEN f.s + {bump} ELSE greatest(f.s * {decay}, {floor}) END
  FROM fold f JOIN nt n ON n.scope = f.scope AND n.i = f.i + 1
), st AS (SELECT scope, topic, arg_max(s, i) AS strength FROM fold GROUP BY ALL)"""


def sharded(per: int) -> str:
    """CTEs as WITH_RECALL, but every scope cut to shards of per facts, each asked its scope's question."""
    return f"""WITH {SENT}, src AS (SELECT scope, seq AS o1, pos AS o2, t FROM sen WHERE NOT contains(t, '?')), {encoded('src', 'whole')},
enc AS (SELECT scope || '#' || (idx // {per})::VARCHAR AS scope, idx, t, raw, c, s, ts, head, selfish FROM whole),
lastq AS (SELECT scope AS home, arg_max(t, idx) AS query FROM whole GROUP BY scope),
qs AS (SELECT home::BIGINT AS qid, scope, query FROM lastq JOIN (SELECT DISTINCT scope, split_part(scope, '#', 1) AS home FROM enc) USING (home)), {recall('qs')}"""


def _copula(ws: str) -> str:
    return f"list_min(list_filter(list_transform(['is', 'are', 'was', 'were'], lambda c: list_position({ws}, c)), lambda p: p > 0))"


CONTESTED = f"""nw AS (SELECT h.scope, h.fact, qs.query, h.coverage, h.overlap, {norm_words('qs.query')} AS a, {norm_words('h.fact')} AS b FROM hits h JOIN qs USING (qid)),
cp AS (SELECT *, {_copula('a')} AS pa, {_copula('b')} AS pb, list_has_any(a, {_set(lex.NEGATORS)}) AS na, list_has_any(b, {_set(lex.NEGATORS)}) AS nb FROM nw WHERE (overlap >= 3 OR coverage >= 0.6) AND len(a) > 0 AND len(b) > 0),
vd AS (SELECT *, CASE WHEN na <> nb THEN 'negation'
  WHEN pa > 1 AND pb > 1 AND array_to_string(a[1:pa - 1], ' ') = array_to_string(b[1:pb - 1], ' ') AND len(a) > pa AND len(b) > pb
    AND len(list_filter(a[pa + 1:], lambda w: strlen(w) >= 3 AND list_contains(b[pb + 1:], w))) = 0 THEN 'value' END AS reason FROM cp)"""

def _turns() -> str:
    """CTEs of every message with its kind, by the order of the rules."""
    some = lambda subs: "(" + " OR ".join(f"contains(l, {_q(x)})" for x in subs) + ")"
    starts = lambda *pre: "(" + " OR ".join(f"starts_with(l, {_q(x)})" for x in pre) + ")"
    signs = "replace(replace(replace(replace(' ' || l || ' ', ' divided by ', ' / '), ' plus ', ' + '), ' minus ', ' - '), ' times ', ' * ')"
    trim = r"[?.!,;:''\"()\[\]{}]*"
    math = rf"(^|\s){trim}([+-]?[0-9]{{1,15}}){trim}\s+([-+*/])\s+{trim}([+-]?[0-9]{{1,15}}){trim}(\s|$)"
    return f"""{MESSAGES}, tu AS (SELECT scope, seq, trim(text) AS u, lower(trim(text)) AS l, list_transform({tokens('trim(text)')}, lambda w: {clean('w')}) AS w, lower(trim(coalesce({tokens('trim(text)')}[1], ''), '?,!')) AS f FROM msg),
tf AS (SELECT *, list_has_any(w, ['my', 'i', 'im', 'mine']) AS mine, {_in('f', rules.YES_NO_WORDS)} OR contains(l, 'yes or no') AS yes_no, regexp_matches({signs}, '{math}') AND NOT contains(u, '=') AS sum FROM tu),
tk AS (SELECT *, contains(u, '?') OR {_in('f', rules.ASK_WORDS)} OR yes_no AS ask, list_has_any(w, ['your', 'you', 'yours']) AND NOT mine AS about,
  {starts('good morning', 'good afternoon', 'good evening')} OR {_in('f', rules.GREETINGS)} OR regexp_matches(f, '^(hi+|hey+|hello+|yo+|sup+|howdy+)$') AS greet FROM tf),
td AS (SELECT scope, seq, yes_no, CASE WHEN about AND ({some(rules.SELF_NAME)} OR {some(rules.SELF_NATURE)}) THEN 'self'
  WHEN greet OR {starts('lol', 'lmao', 'haha', 'hehe', 'thanks', 'thank you', 'thx', 'ty ', 'bye', 'goodbye', 'later', 'gtg', 'good night', 'goodnight')} OR l = 'ty' OR (ask AND {some(rules.HOW_ARE)}) OR ({_in('f', rules.COMMANDS)} AND NOT mine) THEN 'smalltalk'
  WHEN sum THEN 'math' WHEN ask THEN 'question' ELSE 'statement' END AS kind FROM tk)"""


SQL: dict[str, str] = {
    "text_sentences": f"WITH {SENT} SELECT scope, seq, pos, t FROM sen",
    "text_words": f"WITH d AS (SELECT DISTINCT unnest({tokens('coalesce(text, ' + _q('') + ')')}) AS token FROM documents) SELECT token, {clean('token')} AS word, {clip('token')} AS clipped, {stem('(' + clean('token') + ')')} AS stem, {root('token')} AS root, {canon('token')} AS canon, {number('token')} AS number FROM d",
    "text_content": f"WITH {MESSAGES} SELECT scope, seq, array_to_string({content('text')}, ' ') AS content, array_to_string({cue('text')}, ' ') AS cue, len(list_filter(regexp_split_to_array(text, '[^\\p{{L}}\\p{{N}}]+'), lambda x: strlen(x) BETWEEN 2 AND 24)) >= 2 AS prose FROM msg",
    "text_semantic_tokens": f"SELECT doc_id, array_to_string({semantic('text')}, ' ') AS tokens, len({norm_words('text')})::BIGINT AS n_words FROM documents",
    "encode_facts": f"WITH {FACT} SELECT scope, idx, t, c[1] AS v, array_to_string(c, '|') AS c, array_to_string(s, '|') AS s, array_to_string(raw, '|') AS raw, array_to_string(list_transform(s, lambda x: list_position(ts, x) - 1), '|') AS pos, head, selfish AND list_contains(s, 'name') AS self_flag FROM enc",
    "index_postings": f"WITH {FACT}, p AS (SELECT scope, unnest(s) AS stem FROM enc) SELECT scope, stem, count(*) AS df FROM p GROUP BY ALL",
    "scan_catalog": f"WITH {FACT} SELECT scope, count(*) AS facts, sum(length(t))::BIGINT AS chars FROM enc GROUP BY scope",
    "scan_page": f"WITH {FACT} SELECT scope, count(*) AS total, 2 AS start, coalesce(string_agg(t, chr(10) ORDER BY idx) FILTER (WHERE idx BETWEEN 2 AND 4), '') AS facts FROM enc GROUP BY scope",
    "scan_neighbours": f"WITH {FACT} SELECT a.scope, a.idx, greatest(a.idx - 2, 0) AS start, string_agg(b.t, chr(10) ORDER BY b.idx) AS facts FROM enc a JOIN enc b ON a.scope = b.scope AND b.idx BETWEEN a.idx - 2 AND a.idx + 3 GROUP BY a.scope, a.idx",
    "scope_stats": f"WITH {FACT} SELECT scope, least(count(*), 5) AS facts, 5 AS max_facts, greatest(count(*) - 5, 0) AS dropped FROM enc GROUP BY scope",
    "write_drain": f"WITH {FACT}, z AS (SELECT *, row_number() OVER (PARTITION BY scope ORDER BY idx DESC) AS back FROM enc) SELECT scope, row_number() OVER (PARTITION BY scope ORDER BY idx) - 1 AS idx, t FROM z WHERE back <= 3",
    "write_dedup": f"WITH {FACT}, o AS (SELECT *, max(idx) OVER (PARTITION BY scope) AS top FROM enc WHERE idx % 2 = 1) SELECT scope, count(*) AS fresh FROM enc e WHERE idx % 2 = 0 AND NOT EXISTS (SELECT 1 FROM o WHERE o.scope = e.scope AND o.t = e.t AND o.idx > o.top - 4) GROUP BY scope",
    "write_forget": f"WITH {FACT} SELECT scope, row_number() OVER (PARTITION BY scope ORDER BY idx) - 1 AS idx, t FROM enc WHERE NOT contains(lower(t), 'the ')",
    "write_forget_prefix": f"WITH {FACT} SELECT scope, row_number() OVER (PARTITION BY scope ORDER BY idx) - 1 AS idx, t FROM enc WHERE NOT starts_with(lower(t), 'the')",
    "write_strengthen": f"WITH {FACT}, m AS (SELECT scope, lower(left(arg_min(t, idx), 6)) AS m FROM enc GROUP BY scope) SELECT scope, idx, CASE WHEN contains(lower(t), m) THEN 3.5::DOUBLE ELSE 1.0::DOUBLE END AS strength FROM enc JOIN m USING (scope)",
    "write_decay": f"WITH {FACT} SELECT scope, idx, round(CASE WHEN starts_with(lower(t), 'the') THEN (idx % 5) * 0.75::DOUBLE ELSE greatest((idx % 5) * 0.75::DOUBLE * 0.9::DOUBLE, 0.5::DOUBLE) END, 6) AS strength FROM enc",
    "write_upsert": f"WITH {EVK} SELECT scope, row_number() OVER (PARTITION BY scope ORDER BY seq) - 1 AS idx, t, key FROM el WHERE r = 1",
    "write_forget_key": f"WITH {EVK}, l AS (SELECT * FROM el WHERE r = 1) SELECT scope, sum((key = 'click')::INT)::BIGINT AS forgot, sum((key <> 'click')::INT)::BIGINT AS remaining FROM l GROUP BY scope",
    "write_variables": f"WITH {EVK} SELECT scope, key AS name, string_split(t, ' is ')[2] AS value FROM el WHERE r = 1",
    "write_dump": f"WITH {FACT}, b AS (SELECT scope, string_agg('0' || chr(9) || replace(replace(replace(t, '\\', '\\\\'), chr(9), '\\t'), chr(10), '\\n') || chr(9) || '1.0', chr(10) ORDER BY idx) AS blob FROM enc GROUP BY scope) SELECT scope, md5(blob) AS md5, length(blob)::BIGINT AS n FROM b",
    "interned_bytes": f"WITH {FACT}, k AS (SELECT scope, w, count(*) AS n FROM (SELECT scope, unnest({tokens('t')}) AS w FROM enc) GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY scope ORDER BY n DESC, w) AS rk FROM k) SELECT scope, sum(n)::BIGINT AS tokens, count(*) AS vocabulary, sum(strlen(w) + 1 + n * CASE WHEN rk <= 128 THEN 1 WHEN rk <= 16384 THEN 2 ELSE 3 END)::BIGINT AS bytes FROM r GROUP BY scope",
    "recall_top1": f"{WITH_RECALL}, {TOP1} SELECT qid, fact, idx, round(coverage, 9) AS coverage, overlap, exact FROM top1",
    "recall_many": f"{WITH_RECALL}, {many(5)} SELECT qid, rank, idx, round(coverage, 9) AS coverage, overlap, exact FROM hits",
    "recall_assess": f"""{WITH_RECALL}, {TOP1}, {many(8)},
n AS (SELECT qid, count(*) AS n_hits FROM hits GROUP BY qid)
SELECT qs.qid, coalesce(round(coverage, 9), 0) AS coverage, coalesce(overlap, 0) AS overlap, coalesce(exact, 0) AS exact, coalesce(n_hits, 0) AS n_hits FROM qs LEFT JOIN top1 USING (qid) LEFT JOIN n USING (qid)""",
    "recall_orders": "SELECT o_orderkey AS qid, o_orderkey * 2 AS idx, o_orderstatus || 'tatus' AS value, 3 AS overlap, 3 AS exact FROM orders",
    "recall_chain": "SELECT c_custkey AS qid, 'Re' || n_regionkey AS value, 'Cu' || c_custkey || '>Na' || c_nationkey || '>Re' || n_regionkey AS trail FROM customer JOIN nation ON c_nationkey = n_nationkey",
    "spread_one_hop": f"""WITH {FACT}, {LAST},
kue AS (SELECT qid, scope, {cue('query', False)} AS cue FROM qs),
post AS (SELECT scope, idx, unnest(s) AS stem FROM enc), dfs AS (SELECT scope, stem, count(*) AS df FROM post GROUP BY ALL), siz AS (SELECT scope, count(*) AS n FROM enc GROUP BY ALL),
cs AS (SELECT qid, scope, unnest(cue) AS stem FROM kue),
gt AS (SELECT cs.*, df <= greatest(floor(n * 0.25), 64) AS rare FROM cs JOIN dfs USING (scope, stem) JOIN siz USING (scope)),
ga AS (SELECT *, bool_or(rare) OVER (PARTITION BY qid) AS anyr FROM gt),
seed AS (SELECT qid, scope, idx, count(*)::DOUBLE AS act FROM ga JOIN post USING (scope, stem) WHERE rare OR NOT anyr GROUP BY ALL),
lk AS (SELECT scope, stem, df FROM dfs JOIN siz USING (scope) WHERE df >= 2 AND df <= greatest(floor(n * 0.25), 4) AND NOT list_contains({_set(lex.STOP_VALUE_STEMS)}, stem)),
sg AS (SELECT a.qid, a.scope, q.idx, a.act * 0.5 / df AS sig FROM seed a JOIN post p ON p.scope = a.scope AND p.idx = a.idx JOIN lk ON lk.scope = p.scope AND lk.stem = p.stem JOIN post q ON q.scope = p.scope AND q.stem = p.stem AND q.idx <> a.idx WHERE a.act * 0.5 / df >= 1e-6),
al AS (SELECT qid, scope, idx, sum(x) AS act, bool_or(sd) AS seed FROM (SELECT qid, scope, idx, act AS x, true AS sd FROM seed UNION ALL SELECT qid, scope, idx, sig, false FROM sg) GROUP BY ALL),
rk AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(act, 9) DESC, idx) AS rank FROM al)
SELECT qid, rank, idx, seed, round(act, 6) AS act FROM rk WHERE rank <= 8""",
    "rank_fusion": "WITH a AS (SELECT user_id AS qid, event_id AS item, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS r1, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r2 FROM events), b AS (SELECT qid, item, 1.0::DOUBLE / (60 + r1) + 1.0::DOUBLE / (60 + r2) AS score FROM a), c AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, item) AS rank FROM b) SELECT qid, rank, item, round(score, 9) AS score FROM c WHERE rank <= 5",
    "trust_fold": f"WITH {TRUST}, rw AS (SELECT class, sum((delta > 0)::INT)::BIGINT AS rewards, sum((delta < 0)::INT)::BIGINT AS penalties FROM rd GROUP BY class) SELECT class, round(weight, 6) AS weight, rewards, penalties FROM ledger JOIN rw USING (class)",
    "trust_rank": f"WITH {TRUST}, z AS (SELECT user_id AS qid, event_id AS pos, event_type AS class, value * weight AS score FROM events JOIN ledger ON class = event_type), k AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, pos) AS rank FROM z) SELECT qid, pos, class, rank FROM k ",
    "trust_class": f"WITH {MESSAGES} SELECT scope, seq, CASE WHEN seq % 3 = 0 THEN 'src:' || lower(role) WHEN seq % 3 = 1 THEN 'self' ELSE lower(scope) END AS class FROM msg",
    "stance_fold": f"WITH {stance(1.0, 0.9, 0.5)} SELECT scope, topic, 'felt ' || max(seq)::VARCHAR AS feeling, round(any_value(strength), 6) AS strength FROM st JOIN nt USING (scope, topic) GROUP BY scope, topic",
    "stance_persona": f"WITH {stance(1.5 * 1.2, 0.9 + 0.25 * 0.2, 0.5 + 0.2 * 0.4)} SELECT scope, topic, round(strength, 6) AS strength FROM st",
    "vector_cosine": "WITH v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS x FROM embeddings), s AS (SELECT q.id AS qid, c.id, round(list_sum(list_transform(list_zip(q.x, c.x), lambda p: p[1] * p[2])) / (sqrt(list_sum(list_transform(q.x, lambda y: y * y))) * sqrt(list_sum(list_transform(c.x, lambda y: y * y)))), 9) AS cosine FROM v q JOIN v c ON q.id % 20 = 0 AND q.id <> c.id), r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY cosine DESC, id) AS rank FROM s) SELECT qid, rank, id, round(cosine, 6) AS cosine FROM r WHERE rank <= 10",
    "vector_quantize": "WITH a AS (SELECT vec_id, embedding::DOUBLE[] AS x, list_max(list_transform(embedding, lambda y: abs(y::DOUBLE))) / 127 AS sc FROM embeddings) SELECT vec_id, array_to_string(list_transform(x, lambda y: round(y / sc)::INT), ',') AS q, round(sc, 9) AS scale FROM a",
    "vector_cooccurrence": f"WITH {MESSAGES}, k AS (SELECT scope, seq, {semantic('text')} AS ts FROM msg), p AS (SELECT scope, seq, generate_subscripts(ts, 1) AS i, unnest(ts) AS w FROM k) SELECT a.w AS word, b.w AS neighbour, count(*) AS n FROM p a JOIN p b ON a.scope = b.scope AND a.seq = b.seq AND a.i <> b.i AND b.i BETWEEN a.i - 5 AND a.i + 5 GROUP BY ALL",
    "link_partners": "SELECT 'customers' AS scope, 'customer ' || o_custkey AS t, o_orderkey AS id, 'order ' || o_orderkey AS partner FROM orders",
    "link_invert": "SELECT event_id, reverse(event_type) AS word, (-event_id)::VARCHAR AS number FROM events",
    "link_reads": "SELECT user_id::VARCHAR AS scope, event_type AS t, least(count(*), 2)::BIGINT AS served FROM events GROUP BY ALL",
    "adaptive_consolidate": f"WITH {FACT}, w AS (SELECT *, (idx % 4) * 0.5::DOUBLE AS eff, selfish AND list_contains(s, 'name') AS sf FROM enc), g AS (SELECT scope, min(idx) AS idx, count(*) AS merged, sum(eff) AS eff, arg_min(sf, idx) AS sf FROM w GROUP BY scope, s) SELECT scope, idx, merged, round(eff, 6) AS eff FROM g WHERE eff >= 0.4 OR sf",
    "pack_import": f"WITH {SENT}, n AS (SELECT scope, t, row_number() OVER (PARTITION BY scope ORDER BY seq, pos) + 1 AS line FROM sen), f AS (SELECT *, row_number() OVER (PARTITION BY scope, t ORDER BY line) AS r FROM n WHERE NOT starts_with(t, '#') AND NOT starts_with(t, '{{') AND NOT regexp_matches(t, '[\\x00-\\x1F]')) SELECT 'c' || scope AS scope, line, t FROM f WHERE r = 1",
    "recall_sharded": f"""{sharded(4)}, {TOP1},
fin AS (SELECT qid, idx, overlap, exact, split_part(scope, '#', 2)::BIGINT AS shard, row_number() OVER (PARTITION BY qid ORDER BY exact DESC, overlap DESC, coverage DESC, split_part(scope, '#', 2)::BIGINT) AS r FROM top1)
SELECT qid, idx, overlap, exact, shard FROM fin WHERE r = 1""",
    "recall_context": f"""{WITH_RECALL}, {many(3)},
o AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY exact DESC, overlap DESC, coverage DESC, rank) AS k FROM hits),
w AS (SELECT qid, any_value(scope) AS scope, max(idx) FILTER (WHERE k = 1) AS a, max(idx) FILTER (WHERE k = 2) AS b, max(idx) FILTER (WHERE k = 3) AS c FROM o GROUP BY qid),
b2 AS (SELECT qid, scope, a, CASE WHEN abs(b - a) > 1 THEN b END AS b, c FROM w),
b3 AS (SELECT qid, scope, a, b, CASE WHEN abs(c - a) > 1 AND (b IS NULL OR abs(c - b) > 1) THEN c END AS c FROM b2),
pk AS (SELECT qid, scope, unnest(list_filter([a, b, c], lambda x: x IS NOT NULL)) AS idx, generate_subscripts(list_filter([a, b, c], lambda x: x IS NOT NULL), 1) - 1 AS rank FROM b3)
SELECT qid, rank, greatest(pk.idx - 1, 0) AS start, pk.idx - greatest(pk.idx - 1, 0) AS hit_pos, string_agg(e.t, chr(10) ORDER BY e.idx) AS facts
FROM pk JOIN enc e ON e.scope = pk.scope AND e.idx BETWEEN pk.idx - 1 AND pk.idx + 1 GROUP BY qid, rank, pk.idx""",
    "contested_marks": f"""{WITH_RECALL}, {many(4)}, {CONTESTED}
SELECT scope, {fact_key("array_to_string(a, ' ')")} AS hash, left(fact, 160) AS "with", reason FROM vd WHERE reason IS NOT NULL
UNION SELECT scope, {fact_key("array_to_string(b, ' ')")}, left(query, 160), reason FROM vd WHERE reason IS NOT NULL""",
    "affect_directive": f"""WITH {stance(1.0, 0.9, 0.5)},
fl AS (SELECT scope, topic, 'felt ' || max(seq)::VARCHAR AS feeling FROM nt GROUP BY ALL),
md AS (SELECT scope, 'felt ' || max(seq)::VARCHAR AS mood, min(topic) AS asked FROM nt GROUP BY scope)
SELECT md.scope, 'mood: ' || mood || ' view: ' || st.topic || ' (x' || round(strength)::BIGINT::VARCHAR || '): "' || feeling || '"' AS directive
FROM md JOIN st ON st.scope = md.scope AND st.topic = md.asked JOIN fl ON fl.scope = st.scope AND fl.topic = st.topic""",
    "link_measure": "SELECT user_id, min(event_type) AS chosen, count(DISTINCT event_type)::INT AS \"left\" FROM events GROUP BY user_id",
    "turn_classify": f"WITH {_turns()} SELECT scope, seq, kind, yes_no FROM td",
    "recall_across": f"""WITH dm AS (SELECT source || '__' || doc_id::VARCHAR AS scope, text FROM documents WHERE text IS NOT NULL),
d0 AS (SELECT scope, {sentences('text')} AS l FROM dm), sen AS (SELECT scope, generate_subscripts(l, 1) - 1 AS pos, unnest(l) AS t FROM d0),
src AS (SELECT scope, 0 AS o1, pos AS o2, t FROM sen WHERE NOT contains(t, '?')), {encoded('src')},
bq AS (SELECT split_part(scope, '__', 1) AS base, arg_min(t, split_part(scope, '__', 2)::BIGINT) AS query FROM enc WHERE idx = 0 GROUP BY ALL),
qs AS (SELECT regexp_extract(base, '([0-9]+)$', 1)::BIGINT AS qid, scope, query FROM bq JOIN (SELECT DISTINCT scope, split_part(scope, '__', 1) AS base FROM enc) USING (base)),
{recall('qs')}, {many(5)},
fin AS (SELECT qid, scope, idx, overlap, exact, row_number() OVER (PARTITION BY qid ORDER BY exact DESC, overlap DESC, coverage DESC, scope, rank) AS rank FROM hits)
SELECT qid, rank, scope, idx, overlap, exact FROM fin WHERE rank <= 5""",
    "secure_values": f"WITH {EVK} SELECT seq AS qid, scope, string_split(t, ' is ')[2] AS value FROM el WHERE r = 1",
    "link_teleport": """SELECT o_orderkey AS qid, CASE WHEN o_orderkey % 2 = 0 THEN 'order ' || o_orderkey || ' is ' || o_orderstatus ELSE 'order ' || (-o_orderkey) || ' is ' || o_orderstatus END AS dst_fact,
  CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey::VARCHAR ELSE (-o_orderkey)::VARCHAR END AS value, 1 AS ebits_left FROM orders""",
}
