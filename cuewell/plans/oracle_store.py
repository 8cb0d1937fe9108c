"""DuckDB SQL for the queries of ``catalog_store``."""

from __future__ import annotations

from ..functions import lexicon as lex
from ..operators import signals
from .oracle import CAPITAL as _CAPITAL
from .oracle import SQL as _BASE
from .oracle import EVK, FACT, MESSAGES, SENT, TOP1, TRUST, WITH_RECALL, _in, _q, canon, clean, encoded, fact_key, fnv, many, norm_words, number, recall, root, sentences, stance, stem

NL = "chr(10)"
KEYED = f"{EVK}, kf AS (SELECT scope, seq AS o1, 0 AS o2, t, key FROM el WHERE r = 1)"
INSTR = """ir AS (SELECT user_id::VARCHAR AS scope, min(event_id) AS seq, CASE WHEN event_id % 7 = 0 THEN '' ELSE 'Always ' || event_type || ' number ' || (event_id % 4)::VARCHAR END AS text FROM events GROUP BY 1, 3),
held AS (SELECT scope, row_number() OVER (PARTITION BY scope ORDER BY seq) - 1 AS place, text FROM ir WHERE text <> '')"""


def _grown(w: str) -> str:
    """A capitalised candidate with the open capitalised tokens beside it; low, open and cl are lists."""
    cap = _CAPITAL.format(w)
    at = f"(list_position(low, lower({w})) - 1)"
    lo = f"(coalesce(list_max(list_filter(range(0, {at}), lambda j: NOT opn[j + 1])), -1) + 1)"
    hi = f"(coalesce(list_min(list_filter(range({at} + 1, len(cl)), lambda j: NOT opn[j + 1])), len(cl)) - 1)"
    return f"CASE WHEN {cap} AND NOT regexp_matches({w}, '[0-9]') AND {hi} > {lo} THEN array_to_string(cl[{lo} + 1:{hi} + 1], ' ') ELSE {w} END"


def valued(source: str) -> str:
    """CTEs val0..val over a source (qid, scope, idx, kue, want): value and echo of its hits in enc."""
    blocked = sorted(set(lex.STOP) | set(lex.STOP_VALUES))
    place = f"least(coalesce(nullif(list_position(low, lower(w)), 0), 1000001), coalesce(nullif(list_position(cw, {clean('w')}), 0), 1000001)) - 1"
    cand = f"list_transform(c, lambda w: {{'st': {stem('lower(w)')}, 'p': {place}, 'num': {number('w')}, 'x': {_grown('w')}}})"
    cap = _CAPITAL.format("w")
    return f"""
val0 AS (SELECT h.qid, h.scope, h.idx, h.kue, h.want, e.c, e.cw, e.cl, e.ts, list_transform(e.cl, lambda w: lower(w)) AS low,
  list_transform(e.cl, lambda w: {cap} AND NOT ({_in('lower(w)', blocked)})) AS opn FROM {source} h JOIN enc e USING (scope, idx)),
val1 AS (SELECT *, {cand} AS cand, list_filter(range(0, len(ts)), lambda i: list_contains(kue, ts[i + 1])) AS ats FROM val0),
val2 AS (SELECT *, list_filter(cand, lambda x: NOT list_contains(kue, x.st)) AS pool0 FROM val1),
val3 AS (SELECT *, CASE WHEN want AND len(list_filter(pool0, lambda x: x.num)) > 0 THEN list_filter(pool0, lambda x: x.num) ELSE pool0 END AS pool FROM val2),
val4 AS (SELECT *, CASE WHEN len(ats) > 0 AND len(pool) > 1 AND want THEN
    list_sort(list_transform(range(0, len(pool)), lambda i: {{'d': list_min(list_transform(ats, lambda q: abs(pool[i + 1].p - q) * 2 + CASE WHEN pool[i + 1].p <= q THEN 0 ELSE 1 END)), 'i': i, 'x': pool[i + 1].x}}))[1].x
  WHEN len(ats) > 0 AND len(pool) > 1 AND len(list_filter(pool, lambda x: x.p > list_max(ats))) > 0 THEN list_filter(pool, lambda x: x.p > list_max(ats))[1].x
  ELSE pool[1].x END AS best FROM val3),
val AS (SELECT qid, scope, idx, coalesce(best, cand[1].x) AS value, best IS NULL AS echo FROM val4)"""


def _answers() -> str:
    """CTE ask: what every answer is valued by: the cue of a lexical one, the reached words of a rescue."""
    inside = f"list_contains(roots, {root('w')}) OR list_contains(roots, {root('(' + canon('w') + ')')})"
    flags = lambda many_: f"list_contains({many_[0]}, 'many') OR list_contains({many_[0]}, 'much') OR list_contains({many_[0]}, {_q(many_[1])})"
    return f"""{TOP1},
ask AS (SELECT w3.qid, w3.scope, w3.idx, k.cue AS kue, {flags(('k.cue', lex.stem_word('number')))} AS want FROM w3 JOIN kue k USING (qid, scope) WHERE (w3.qid, w3.scope) NOT IN (SELECT (qid, scope) FROM better)
  UNION ALL SELECT b.qid, b.scope, b.idx, list_transform(list_filter(r.raw, lambda w: {inside}), lambda w: {stem('w')}) AS kue, {flags(('k.q', 'number'))} AS want FROM better b JOIN rs1 r USING (qid, scope, idx) JOIN kue k USING (qid, scope)),
{valued('ask')}"""


def _fade(tick: str, at: str) -> str:
    return f"pow(0.5::DOUBLE, ({tick} - {at}) / 1000.0::DOUBLE)"


DESCRIBED = "coalesce(nullif(concat_ws(', ', " + ", ".join(f"CASE WHEN {n} >= 0.66 THEN {_q(hi)} WHEN {n} <= 0.34 THEN {_q(lo)} END" for n, (hi, lo) in signals.TRAIT_WORDS.items()) + f"), ''), {_q(signals.BALANCED)})"

STATUS = "'the status of order ' || o_orderkey || ' is ' || o_orderstatus || 'tatus'"
CLAIM = f"CASE WHEN o_orderkey % 3 = 0 THEN replace({STATUS}, ' is ', ' is not ') WHEN o_orderkey % 3 = 1 THEN 'the status of order ' || o_orderkey || ' is changed' ELSE upper({STATUS}) END"
MARKS = f"""mk0 AS (SELECT {STATUS} AS fact, {CLAIM} AS claim, CASE WHEN o_orderkey % 3 = 0 THEN 'negation' ELSE 'value' END AS reason FROM orders WHERE o_orderkey % 3 < 2),
mk AS (SELECT 'orders' AS scope, {fact_key("array_to_string(" + norm_words('claim') + ", ' ')")} AS hash, fact AS "with", reason FROM mk0 UNION SELECT 'orders', {fact_key("array_to_string(" + norm_words('fact') + ", ' ')")}, claim, reason FROM mk0)"""
LINK = "lk AS (SELECT o_orderkey AS id, 's' || (o_orderkey % 5) AS ss, 'order ' || o_orderkey AS st, 's' || (o_custkey % 5) AS ds, 'customer ' || o_custkey AS dt FROM orders)"


SQL: dict[str, str] = {
    "text_hashes": f"WITH p AS (SELECT p_partkey, p_name || ' - ' || p_brand || ' - ' || p_type AS text FROM part) SELECT p_partkey, {fact_key('array_to_string(' + norm_words('text') + ', ' + _q(' ') + ')')} AS key, {fnv('text', 1469598103934665603)} % 16 = 0 AS sampled FROM p",
    "text_escapes": "SELECT event_id, replace(replace(replace(props || chr(9) || '\\', '\\', '\\\\'), '\"', '\\\"'), chr(9), '\\t') AS escaped, 'q=' || event_type || ' no. ' || event_id AS decoded FROM events",
    "scan_scope": f"WITH {FACT} SELECT scope, row_number() OVER (PARTITION BY scope ORDER BY idx) - 1 AS place, t FROM enc WHERE idx % 3 <> 1",
    "scan_episodes": f"WITH {FACT} SELECT scope, idx, t, c[1] AS v, len(c)::INT AS candidates, 1.0::DOUBLE AS strength FROM enc",
    "scan_updates": f"WITH {MESSAGES}, b AS (SELECT scope, min(seq) AS created, max(seq) AS updated, count(*) AS turns FROM msg GROUP BY scope) SELECT *, row_number() OVER (ORDER BY updated DESC, scope) AS place FROM b",
    "scan_has_fact": f"WITH {FACT} SELECT DISTINCT scope, t FROM sen WHERE pos <= 1 AND (scope, t) IN (SELECT (scope, t) FROM enc WHERE idx % 2 = 0)",
    "log_replay": f"WITH {FACT} SELECT scope, idx, t FROM enc",
    "log_compaction": """WITH e AS (SELECT (user_id % 20)::VARCHAR AS scope, event_id AS seq FROM events), r AS (SELECT *, seq % 4 = 0 AND scope < '3' AS low FROM e),
n AS (SELECT scope, count(*) FILTER (WHERE low) AS stored, count(*) FILTER (WHERE NOT low) AS logged FROM r GROUP BY scope)
SELECT scope, CASE WHEN logged >= greatest(stored, 256) THEN stored + logged ELSE stored END AS stored, CASE WHEN logged >= greatest(stored, 256) THEN 0 ELSE logged END AS logged FROM n""",
    "write_durable": f"""WITH m0 AS (SELECT conv_id::VARCHAR AS scope, turn AS seq, text FROM conversations), mm AS (SELECT * FROM m0 UNION ALL SELECT scope, seq + 1000, text FROM m0),
d0 AS (SELECT scope, seq, {sentences('text')} AS l FROM mm),
sen AS (SELECT scope, seq, generate_subscripts(l, 1) - 1 AS pos, unnest(l) AS t FROM d0), src AS (SELECT scope, seq AS o1, pos AS o2, t FROM sen WHERE NOT contains(t, '?')), {encoded('src')},
fs AS (SELECT scope, t, min(o1) AS first FROM enc GROUP BY ALL),
kp AS (SELECT mm.scope, mm.seq FROM mm LEFT JOIN fs ON fs.scope = mm.scope AND fs.t = trim(mm.text) WHERE fs.first IS NULL OR fs.first >= mm.seq)
SELECT e.scope, row_number() OVER (PARTITION BY e.scope ORDER BY o1, o2) - 1 AS idx, t FROM enc e JOIN kp ON kp.scope = e.scope AND kp.seq = e.o1""",
    "write_load": f"WITH {FACT} SELECT scope, idx, t, CASE WHEN idx % 4 = 0 THEN 'k' || chr(9) || idx END AS key, 1.0::DOUBLE AS strength FROM enc",
    "write_pack": _BASE["write_dump"],
    "write_wipe": f"""WITH {FACT}, k AS (SELECT scope || ['::var', '::instr', '::stance', '::affect', '::persona', '__doc', '::other'][idx + 1] AS scope, scope AS base, idx FROM enc WHERE idx < 7),
a AS (SELECT scope, scope AS base, 9 AS idx FROM enc UNION ALL SELECT * FROM k)
SELECT scope, count(*) AS facts FROM a WHERE base::BIGINT % 2 = 1 OR idx IN (5, 6) GROUP BY scope""",
    "write_replace": f"WITH {FACT} SELECT scope, idx, CASE WHEN scope::BIGINT % 3 = 0 THEN 'again ' || t ELSE t END AS t FROM enc WHERE scope::BIGINT % 3 <> 0 OR idx < 2",
    "write_import": f"""WITH {FACT}, h AS (SELECT scope, t, idx FROM enc WHERE idx % 2 = 0), pk AS (SELECT scope, idx AS line, t FROM enc UNION ALL SELECT scope, -1, 'the pack holds one more fact' FROM enc WHERE idx = 0),
n AS (SELECT * FROM pk WHERE (scope, t) NOT IN (SELECT (scope, t) FROM h)), u AS (SELECT scope, 0 AS part, idx AS o, t FROM h UNION ALL SELECT scope, 1, line, t FROM n)
SELECT scope, row_number() OVER (PARTITION BY scope ORDER BY part, o) - 1 AS idx, t FROM u""",
    "write_rewrite": f"""WITH {FACT}, ch AS (SELECT scope, t AS old, 'rewritten fact number ' || idx AS new, min(idx) OVER (PARTITION BY scope, t) AS at FROM (SELECT *, min(idx) OVER (PARTITION BY scope, t) AS f FROM enc) WHERE idx % 5 = 0),
c2 AS (SELECT ch.scope, new, (SELECT min(idx) FROM enc e WHERE e.scope = ch.scope AND e.t = ch.old) AS hit FROM ch),
u AS (SELECT scope, 0 AS part, idx AS o, t, idx + 0.5::DOUBLE AS strength FROM enc WHERE (scope, idx) NOT IN (SELECT (scope, hit) FROM c2) UNION ALL SELECT scope, 1, hit, new, hit + 0.5::DOUBLE FROM c2)
SELECT scope, row_number() OVER (PARTITION BY scope ORDER BY part, o, t) - 1 AS idx, t, strength FROM u""",
    "write_reinforce": """WITH f AS (SELECT user_id::VARCHAR AS scope, event_type AS topic, min(event_id) AS a FROM events GROUP BY ALL), l AS (SELECT user_id::VARCHAR AS scope, max(event_id) AS z, arg_max(event_type, event_id) AS topic FROM events GROUP BY user_id),
u AS (SELECT f.scope, CASE WHEN f.topic = l.topic THEN 1 ELSE 0 END AS part, f.topic AS o, CASE WHEN f.topic = l.topic THEN upper(f.topic) || ': felt ' || z ELSE f.topic || ': felt ' || a END AS t, CASE WHEN f.topic = l.topic THEN 1.5::DOUBLE ELSE 1.0::DOUBLE END AS strength FROM f JOIN l USING (scope))
SELECT scope, row_number() OVER (PARTITION BY scope ORDER BY part, o) - 1 AS idx, t, strength FROM u""",
    "instructions": f"WITH {INSTR} SELECT scope, place, text FROM held",
    "instructions_deleted": f"WITH {INSTR} SELECT scope, row_number() OVER (PARTITION BY scope ORDER BY place) - 1 AS place, text FROM held WHERE NOT contains(lower(text), 'click') AND scope::BIGINT % 2 = 1",
    "variables_list": f"WITH {EVK} SELECT scope, key AS name, string_split(t, ' is ')[2] AS value, row_number() OVER (PARTITION BY scope ORDER BY key) AS place FROM el WHERE r = 1",
    "variables_deleted": f"WITH {EVK}, n AS (SELECT scope, count(*) AS n, count(*) FILTER (WHERE key = 'click') AS c FROM el WHERE r = 1 GROUP BY scope) SELECT scope, 'CLICK' AS name, c::INT AS deleted, n - c AS held FROM n UNION ALL SELECT scope, 'no such name', 0, n - c FROM n",
    "recall_scored": f"WITH x AS (SELECT o_orderkey AS qid, {CLAIM} AS claim FROM orders) SELECT qid, qid % 3 < 2 AS contested, CASE WHEN qid % 3 < 2 THEN claim END AS \"with\" FROM x",
    "write_checked": f"WITH {MARKS} SELECT scope, hash, \"with\", reason FROM mk",
    "contested_stored": f"WITH {MARKS} SELECT scope, hash, min(\"with\") AS \"with\" FROM mk GROUP BY scope, hash",
    "scope_samples": f"""WITH g AS (SELECT 'Cu' || c_custkey || ' nation is Na' || c_nationkey AS t, 'Na' || c_nationkey AS f FROM customer UNION ALL SELECT 'Na' || n_nationkey || ' region is Re' || n_regionkey, 'Re' || n_regionkey FROM nation)
SELECT 'scope:' || f AS class, count(*) AS n FROM g WHERE {fnv('t', 1469598103934665603)} % 16 = 0 GROUP BY f""",
    "recall_keyed": f"""WITH {KEYED}, src AS (SELECT scope, o1, o2, t FROM kf), {encoded('src')}, qs AS (SELECT DISTINCT scope::BIGINT AS qid, scope, 'what is the last click value' AS query FROM kf), {recall('qs')}, {many(3)}
SELECT qid, rank, hits.idx, key, overlap FROM hits JOIN enc USING (scope, idx) JOIN kf ON kf.scope = enc.scope AND kf.o1 = enc.o1""",
    "recall_why": f"""WITH {stance(1.0, 0.9, 0.5)}, {KEYED}, src AS (SELECT scope, o1, o2, t FROM kf), {encoded('src')},
tpc AS (SELECT scope, arg_min(topic, seq) AS topic FROM nt GROUP BY scope), qs AS (SELECT scope::BIGINT AS qid, scope, topic AS query FROM tpc), {recall('qs')}, {many(3)},
ev AS (SELECT qid, string_agg(fact, {NL} ORDER BY rank) AS evidence FROM hits GROUP BY qid), fl AS (SELECT scope, topic, 'felt ' || max(seq)::VARCHAR AS feeling FROM nt GROUP BY ALL)
SELECT tpc.scope::BIGINT AS qid, tpc.topic, fl.feeling, round(st.strength, 6) AS intensity, coalesce(evidence, '') AS evidence
FROM tpc JOIN st USING (scope, topic) JOIN fl USING (scope, topic) LEFT JOIN ev ON ev.qid = tpc.scope::BIGINT""",
    "recall_value_family": "SELECT c_custkey AS qid, 'geo' AS scope, 'Na' || c_nationkey AS value FROM customer",
    "recall_value": f"{WITH_RECALL}, {_answers()} SELECT qid, scope, value, echo FROM val",
    "turn_route": f"""{WITH_RECALL}, {_answers()}, {many(8)},
n AS (SELECT qid, count(*) AS n_hits FROM hits GROUP BY qid),
rt AS (SELECT CASE WHEN coalesce(NOT echo AND value <> '', false) AND coalesce(coverage, 0) >= 0.5 THEN 'ANSWER' WHEN coalesce(n_hits, 0) > 0 THEN 'FETCH' ELSE 'ESCALATE' END AS route
  FROM qs LEFT JOIN top1 USING (qid) LEFT JOIN val USING (qid) LEFT JOIN n USING (qid))
SELECT route, count(*) AS n FROM rt GROUP BY route""",
    "recall_fire": f"{WITH_RECALL}, {TOP1}, cl AS (SELECT qid, string_agg(idx::VARCHAR, ',' ORDER BY idx) AS candidates FROM cand GROUP BY qid) SELECT qs.qid, coalesce(top1.idx, -1) AS idx, coalesce(candidates, '') AS candidates FROM qs LEFT JOIN top1 USING (qid) LEFT JOIN cl USING (qid)",
    "recall_chain_steps": "SELECT c_custkey AS qid, NULL::VARCHAR AS value, c_custkey::VARCHAR || ',' || (-1 - n_nationkey)::VARCHAR AS steps FROM customer JOIN nation ON c_nationkey = n_nationkey",
    "index_stored": f"WITH {FACT}, p AS (SELECT scope, unnest(s) AS stem FROM enc) SELECT scope, stem, count(*) AS df FROM p GROUP BY ALL",
    "recall_stored": f"{WITH_RECALL}, {TOP1} SELECT qid, fact, idx, round(coverage, 9) AS coverage, overlap, exact FROM top1",
    "model_saved": f"WITH {TRUST}, rw AS (SELECT class, sum((delta > 0)::INT)::BIGINT AS rewards, sum((delta < 0)::INT)::BIGINT AS penalties FROM rd GROUP BY class) SELECT class, round(weight, 6) AS weight, rewards, penalties, true AS once FROM ledger JOIN rw USING (class)",
    "persona_described": "WITH e AS (SELECT user_id::VARCHAR AS scope, sum(floor(value))::BIGINT AS s FROM events GROUP BY user_id), p AS (SELECT scope, " + ", ".join(f"(s // {3**i}) % 101 / 100 AS {n}" for i, n in enumerate(["openness", "conscientiousness", "extraversion", "agreeableness", "neuroticism"])) + f" FROM e) SELECT scope, {DESCRIBED} AS words, round(openness, 4) AS openness, 1.5::DOUBLE AS reactivity FROM p",
    "link_disentangle": f"WITH {LINK}, l AS (SELECT * FROM lk WHERE id % 3 <> 0), e AS (SELECT ss AS scope, id FROM l UNION SELECT ds, id FROM l) SELECT scope, count(*) AS links, sum(id)::BIGINT AS ids FROM e GROUP BY scope",
    "link_entangle": f"WITH {LINK}, n AS (SELECT *, row_number() OVER (ORDER BY ss, st, ds, dt) + (SELECT max(id) FROM lk WHERE id % 4 <> 0) AS nid FROM lk WHERE id % 4 = 0) SELECT id, st AS src_text, 1 AS ebits FROM lk WHERE id % 4 <> 0 UNION ALL SELECT nid, st, 1 FROM n",
    "link_missing_ends": f"WITH {LINK}, e AS (SELECT ss AS scope, st AS t FROM lk UNION SELECT ds, dt FROM lk), h AS (SELECT ss, st FROM lk WHERE id % 2 = 0) SELECT scope, count(*) AS missing FROM e WHERE (scope, t) NOT IN (SELECT (ss, st) FROM h) GROUP BY scope",
    "link_cascade": "WITH o AS (SELECT o_orderkey AS k, 'order ' || o_orderkey || ' stands' AS f FROM orders WHERE o_orderkey % 3 = 0) SELECT k AS qid, 1 AS hop, 'customers' AS dst_scope, f AS dst_fact FROM o UNION ALL SELECT k, 2, 'nations', f FROM o WHERE k % 2 = 0",
    "link_superpose": """WITH e AS (SELECT user_id::VARCHAR AS scope, event_type, min(event_id) AS f FROM events GROUP BY ALL), s AS (SELECT scope, arg_min(event_type, f) AS answer, count(*) AS n FROM e GROUP BY scope)
SELECT scope, answer, 3::BIGINT AS served, 0 AS "left", 0::BIGINT AS reads FROM s""",
    "link_survivors": "WITH e AS (SELECT user_id::VARCHAR AS scope, min(event_type) AS t, count(DISTINCT event_type) AS n FROM events WHERE event_id % 150 <> 0 GROUP BY user_id) SELECT scope, t FROM e WHERE scope::BIGINT % 2 = 0 OR n = 1",
    "link_place": """WITH RECURSIVE sc AS (SELECT format('c{:09d}', c_custkey) AS scope, row_number() OVER (ORDER BY c_custkey) AS n FROM customer),
p(n, l, shard) AS (SELECT 0::BIGINT, [0, 1, 4, 9, 16]::BIGINT[], -1::BIGINT UNION ALL
  SELECT p.n + 1, list_transform(range(0, 5), lambda i: p.l[i + 1] + CASE WHEN i + 1 = list_position(p.l, list_min(p.l)) THEN 1 ELSE 0 END), (list_position(p.l, list_min(p.l)) - 1)::BIGINT FROM p WHERE p.n < (SELECT count(*) FROM customer))
SELECT scope, shard FROM sc JOIN p USING (n)""",
    "turn_capacity": f"""WITH {FACT}, h AS (SELECT scope, count(*) AS held FROM enc GROUP BY scope), w AS (SELECT scope, o1, count(*) AS wrote FROM enc GROUP BY ALL)
SELECT m.seq AS qid, m.scope, coalesce(wrote, 0) AS wrote, least(coalesce(held, 0) + coalesce(wrote, 0), 30) AS facts, coalesce(held, 0) >= 30 AND coalesce(wrote, 0) > 0 AS capacity_reached FROM msg m LEFT JOIN h USING (scope) LEFT JOIN w ON w.scope = m.scope AND w.o1 = m.seq""",
    "stream_capture": f"WITH {SENT}, src AS (SELECT DISTINCT 'all' AS scope, 0 AS o1, md5(t) AS o2, t FROM sen WHERE NOT contains(t, 'the')), {encoded('src')} SELECT scope, t FROM enc",
    "adaptive_strength": f"""WITH e AS (SELECT user_id::VARCHAR AS scope, dense_rank() OVER (PARTITION BY user_id ORDER BY event_type) AS idx, event_id AS tick FROM events),
g AS (SELECT scope, idx, min(tick) AS a, max(tick) AS z, count(*) AS n FROM e GROUP BY ALL),
r AS (SELECT scope, idx, CASE WHEN idx = 2 THEN 1.0::DOUBLE ELSE {_fade('z', 'a')} + 0.25 * n END AS w, CASE WHEN idx = 2 THEN a ELSE z END AS tick FROM g)
SELECT scope, idx, round(w * {_fade('10000', 'tick')}, 9) AS eff, count(*) OVER (PARTITION BY scope) AS facts FROM r""",
}
