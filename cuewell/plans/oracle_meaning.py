"""DuckDB SQL for vectors, recall by meaning, k-means, spreading and adaptive sessions."""

from __future__ import annotations

from ..functions import lexicon as lex
from .oracle import FACT, LAST, MESSAGES, TOP1, TRUST, _set, cue, fnv, recall, semantic

_M = "18446744073709551616::UHUGEINT"


def _splitmix(x: str) -> str:
    """Nested steps of a 64-bit mixer over an unsigned 128-bit number."""
    step = lambda v, shift, by, name: f"list_transform([{v}], lambda {name}: (xor({name}, {name} // {1 << shift}::UHUGEINT) * {by}::UHUGEINT) % {_M})[1]"
    a = step(f"({x} + {0x9E3779B97F4A7C15}::UHUGEINT) % {_M}", 30, 0xBF58476D1CE4E5B9, "a")
    b = step(a, 27, 0x94D049BB133111EB, "b")
    return f"list_transform([{b}], lambda z: xor(z, z // {1 << 31}::UHUGEINT))[1]"


CO = f"""sk AS (SELECT scope, seq, {semantic('text')} AS sts FROM msg), sp AS (SELECT scope, seq, generate_subscripts(sts, 1) AS i, unnest(sts) AS w FROM sk),
co AS (SELECT a.w AS word, b.w AS neighbour, count(*) AS n FROM sp a JOIN sp b ON a.scope = b.scope AND a.seq = b.seq AND a.i <> b.i AND b.i BETWEEN a.i - 5 AND a.i + 5 GROUP BY ALL)"""
CONTEXT = f"""{CO},
fh AS MATERIALIZED (SELECT w, {fnv('w', 1469598103934665603)} AS h FROM (SELECT DISTINCT neighbour AS w FROM co)),
dr AS (SELECT w, {_splitmix(f'xor(h, (k::UHUGEINT * {0x100000001B3}::UHUGEINT) % {_M})')} AS r FROM fh, range(0, 12) t(k)),
ix AS MATERIALIZED (SELECT w, (r % 256::UHUGEINT)::INT AS dim, sum(CASE WHEN (r // {1 << 33}::UHUGEINT) % 2::UHUGEINT = 0 THEN 1 ELSE -1 END) AS x FROM dr GROUP BY ALL),
cv AS MATERIALIZED (SELECT word, dim, sum(n * x)::BIGINT AS val FROM co JOIN ix ON neighbour = w GROUP BY ALL HAVING sum(n * x) <> 0)"""
UNIT = f"""{CONTEXT},
un AS MATERIALIZED (SELECT word, dim, val / sqrt(sum(val::DOUBLE * val) OVER (PARTITION BY word)) AS x FROM cv)"""


def embedded(name: str, source: str, keys: str, text: str) -> str:
    """CTE of unit vectors (keys, dim, val) of a source's texts."""
    return f"""
{name}_t AS (SELECT {keys}, unnest({semantic(text)}) AS word FROM {source}),
{name}_s AS (SELECT {keys}, dim, sum(x) AS val FROM {name}_t JOIN un USING (word) GROUP BY ALL),
{name} AS MATERIALIZED (SELECT {keys}, dim, val / sqrt(sum(val * val) OVER (PARTITION BY {keys})) AS val FROM {name}_s)"""


LASTM = "qs AS (SELECT scope::BIGINT AS qid, scope, arg_max(text, seq) AS query FROM msg GROUP BY scope)"
NEAR = f"""{UNIT}, {embedded('eq', 'qs', 'qid, scope', 'query')}, {embedded('ef', 'enc', 'scope, idx', 't')},
nr AS MATERIALIZED (SELECT qid, scope, idx, round(sum(q.val * f.val), 9) AS cosine FROM eq q JOIN ef f USING (scope, dim) GROUP BY qid, scope, idx),
nq AS (SELECT q.qid, q.scope, f.idx, coalesce(cosine, 0) AS cosine FROM (SELECT DISTINCT qid, scope FROM eq) q JOIN (SELECT DISTINCT scope, idx FROM ef) f USING (scope) LEFT JOIN nr USING (qid, scope, idx))"""
STANDOUT = """so AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY cosine DESC, idx) AS rank, count(*) OVER (PARTITION BY qid) AS n FROM nq),
sm AS (SELECT qid, max(cosine) FILTER (WHERE rank = n // 2 + 1) AS middle, max(cosine) FILTER (WHERE rank = 1) AS top, max(idx) FILTER (WHERE rank = 1) AS idx, max(n) AS n FROM so GROUP BY qid),
sem AS (SELECT qid, idx, top FROM sm WHERE top >= 0.20 AND (n < 3 OR top - middle >= 0.10))"""
WORDS3 = r"list_filter(regexp_split_to_array(lower(query), '[^\p{L}\p{N}]+'), lambda w: strlen(w) >= 3)"


def _kmeans(k: int, iterations: int) -> str:
    """Unrolled steps of cosine k-means from evenly placed rows."""
    out = f"""WITH x AS (SELECT vec_id AS id, embedding::DOUBLE[] AS e FROM embeddings),
u AS MATERIALIZED (SELECT id, list_transform(e, lambda y: y / greatest(sqrt(list_sum(list_transform(e, lambda z: z * z))), 1e-9)) AS u, row_number() OVER (ORDER BY id) - 1 AS r FROM x),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY r) - 1 AS c, u AS v FROM u WHERE r IN (SELECT ((SELECT count(*) FROM x) * c) // {k} FROM range(0, {k}) t(c)))"""
    near = "(SELECT id, u, c, row_number() OVER (PARTITION BY id ORDER BY list_inner_product(u, v) DESC, c) AS k FROM u, c{0})"
    for i in range(iterations - 1):
        out += f""",
a{i} AS MATERIALIZED (SELECT id, u, c FROM {near.format(i)} WHERE k = 1),
s{i} AS (SELECT c, d, sum(y) AS y FROM (SELECT c, generate_subscripts(u, 1) AS d, unnest(u) AS y FROM a{i}) GROUP BY ALL),
n{i} AS (SELECT c, list(y ORDER BY d) AS y FROM s{i} GROUP BY c),
c{i + 1} AS MATERIALIZED (SELECT c{i}.c, coalesce(list_transform(y, lambda z: z / greatest(sqrt(list_sum(list_transform(y, lambda t: t * t))), 1e-9)), v) AS v FROM c{i} LEFT JOIN n{i} USING (c))"""
    return out + f" SELECT id, c::INT AS cluster FROM {near.format(iterations - 1)} WHERE k = 1"


def _settled(steps: int) -> str:
    """Spreading unrolled until nothing new is lit: steps beyond the last one change nothing."""
    out = f"""WITH {FACT}, {LAST},
kue AS (SELECT qid, scope, {cue('query', False)} AS cue FROM qs),
post AS MATERIALIZED (SELECT scope, idx, unnest(s) AS stem FROM enc), dfs AS MATERIALIZED (SELECT scope, stem, count(*) AS df FROM post GROUP BY ALL), siz AS (SELECT scope, count(*) AS n FROM enc GROUP BY ALL),
cs AS (SELECT qid, scope, unnest(cue) AS stem FROM kue),
gt AS (SELECT cs.*, df <= greatest(floor(n * 0.25), 64) AS rare FROM cs JOIN dfs USING (scope, stem) JOIN siz USING (scope)),
ga AS (SELECT *, bool_or(rare) OVER (PARTITION BY qid) AS anyr FROM gt),
a0 AS MATERIALIZED (SELECT qid, scope, idx, count(*)::DOUBLE AS act, true AS seed FROM ga JOIN post USING (scope, stem) WHERE rare OR NOT anyr GROUP BY ALL),
f0 AS MATERIALIZED (SELECT qid, scope, idx, act FROM a0),
lk AS MATERIALIZED (SELECT scope, stem, df FROM dfs JOIN siz USING (scope) WHERE df >= 2 AND df <= greatest(floor(n * 0.25), 4) AND NOT list_contains({_set(lex.STOP_VALUE_STEMS)}, stem))"""
    for i in range(steps):
        out += f""",
g{i} AS MATERIALIZED (SELECT f.qid, f.scope, q.idx, sum(f.act * 0.5 / df) AS act FROM f{i} f JOIN post p ON p.scope = f.scope AND p.idx = f.idx JOIN lk ON lk.scope = p.scope AND lk.stem = p.stem JOIN post q ON q.scope = p.scope AND q.stem = p.stem AND q.idx <> f.idx WHERE f.act * 0.5 / df >= 1e-6 GROUP BY ALL),
a{i + 1} AS MATERIALIZED (SELECT qid, scope, idx, sum(act) AS act, bool_or(seed) AS seed FROM (SELECT * FROM a{i} UNION ALL SELECT qid, scope, idx, act, false FROM g{i}) GROUP BY ALL),
f{i + 1} AS MATERIALIZED (SELECT g.qid, g.scope, g.idx, g.act FROM g{i} g ANTI JOIN a{i} USING (qid, scope, idx))"""
    return out + f", rk AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(act, 9) DESC, idx) AS rank FROM a{steps}) SELECT qid, rank, idx, seed, round(act, 6) AS act FROM rk WHERE rank <= 8"


def spread_once(k: int) -> str:
    """CTEs over qs (qid, scope, query) and enc: rk1, the k facts of highest activation after one hop."""
    return f"""
kue AS (SELECT qid, scope, {cue('query', False)} AS cue FROM qs),
post AS MATERIALIZED (SELECT scope, idx, unnest(s) AS stem FROM enc), dfs AS MATERIALIZED (SELECT scope, stem, count(*) AS df FROM post GROUP BY ALL), siz AS (SELECT scope, count(*) AS n FROM enc GROUP BY ALL),
cs AS (SELECT qid, scope, unnest(cue) AS stem FROM kue),
gt AS (SELECT cs.*, df <= greatest(floor(n * 0.25), 64) AS rare FROM cs JOIN dfs USING (scope, stem) JOIN siz USING (scope)),
ga AS (SELECT *, bool_or(rare) OVER (PARTITION BY qid, scope) AS anyr FROM gt),
seed AS MATERIALIZED (SELECT qid, scope, idx, count(*)::DOUBLE AS act FROM ga JOIN post USING (scope, stem) WHERE rare OR NOT anyr GROUP BY ALL),
lk AS (SELECT scope, stem, df FROM dfs JOIN siz USING (scope) WHERE df >= 2 AND df <= greatest(floor(n * 0.25), 4) AND NOT list_contains({_set(lex.STOP_VALUE_STEMS)}, stem)),
sg AS (SELECT a.qid, a.scope, q.idx, a.act * 0.5 / df AS sig FROM seed a JOIN post p ON p.scope = a.scope AND p.idx = a.idx JOIN lk ON lk.scope = p.scope AND lk.stem = p.stem JOIN post q ON q.scope = p.scope AND q.stem = p.stem AND q.idx <> a.idx WHERE a.act * 0.5 / df >= 1e-6),
al AS (SELECT qid, scope, idx, sum(x) AS act, bool_or(sd) AS seed FROM (SELECT qid, scope, idx, act AS x, true AS sd FROM seed UNION ALL SELECT qid, scope, idx, sig, false FROM sg) GROUP BY ALL),
rk1 AS (SELECT *, row_number() OVER (PARTITION BY qid, scope ORDER BY round(act, 9) DESC, idx) AS rank FROM al QUALIFY rank <= {k})"""


SESSION = f"""WITH RECURSIVE {FACT}, qs AS (SELECT idx AS qid, scope, t AS query FROM enc), {recall('qs', expand=False)},
cd AS (SELECT scope, qid AS seq, list({{'e': exact, 'f': selfp::INT, 'g': subj::INT, 's': spec, 'i': idx}}) AS cs FROM sc
  WHERE (ov >= 1 OR (petq AND es_pet)) AND (NOT loose_fact OR (petq AND es_pet)) AND (NOT loose_cue OR (petq AND es_pet)) GROUP BY ALL),
sq AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY scope ORDER BY seq) - 1 AS tick FROM cd),
rc(scope, tick, seq, w, since, b) AS (
  SELECT scope, -1::BIGINT, -1::BIGINT, list_transform(range(0, n), lambda x: 1.0::DOUBLE), list_transform(range(0, n), lambda x: 0::BIGINT), {{'e': 0::BIGINT, 'w': 0.0::DOUBLE, 'f': 0, 'g': 0, 's': 0::BIGINT, 'i': 0::BIGINT}} FROM siz
  UNION ALL
  SELECT scope, tick, seq, list_transform(w, lambda x, k: CASE WHEN k = b.i + 1 THEN b.w + 1.0 ELSE x END), list_transform(since, lambda x, k: CASE WHEN k = b.i + 1 THEN tick ELSE x END), b
  FROM (SELECT r.scope, s.tick, s.seq, r.w, r.since,
      list_sort(list_transform(s.cs, lambda x: {{'e': x.e::BIGINT, 'w': r.w[x.i + 1] * pow(0.5::DOUBLE, (s.tick - r.since[x.i + 1]) / 8.0::DOUBLE), 'f': x.f, 'g': x.g, 's': x.s::BIGINT, 'i': x.i::BIGINT}}), 'DESC')[1] AS b
    FROM rc r JOIN sq s ON s.scope = r.scope AND s.tick = r.tick + 1)
), ses AS (SELECT rc.scope, seq AS qid, b.i AS idx, t AS fact, round(b.w, 9) AS weight, tick FROM rc JOIN enc ON enc.scope = rc.scope AND enc.idx = b.i WHERE tick >= 0)"""

K, SWEEPS = 8, 6


def _cols(form: str, sep: str = ", ") -> str:
    return sep.join(form.format(i=i) for i in range(K))


def _topics() -> str:
    """CTEs of word topics by unrolled sweeps of expectation and maximisation: asg (id, word, topic, n)."""
    draw = "(strpos('0123456789abcdef', substr(h, {p}, 1)) - 1)"
    number = lambda i: "list_transform([md5(word || ':" + str(i) + "')], lambda h: " + " + ".join(f"{draw.format(p=p + 1)} * {16 ** (5 - p)}" for p in range(6)) + ")[1]"
    out = f"""tx AS (SELECT scope || '/' || seq AS id, scope, seq, {semantic('text')} AS ws FROM msg),
voc AS (SELECT word FROM (SELECT unnest(list_distinct(ws)) AS word FROM tx) GROUP BY word HAVING count(*) >= 2 AND count(*) <= greatest((SELECT count(*) FROM tx) / 4, 64)),
tk AS MATERIALIZED (SELECT id, word, count(*) AS n FROM (SELECT id, unnest(ws) AS word FROM tx) JOIN voc USING (word) GROUP BY ALL),
vs AS (SELECT greatest(count(*), 1) AS v FROM voc),
kw0 AS MATERIALIZED (SELECT word, {', '.join(f'1.0::DOUBLE + ({number(i)} % 1000) / 500.0::DOUBLE AS k{i}' for i in range(K))} FROM (SELECT DISTINCT word FROM tk)),
dk0 AS MATERIALIZED (SELECT id, {_cols('1.0::DOUBLE AS d{i}')} FROM (SELECT DISTINCT id FROM tk))"""
    for s in range(SWEEPS):
        out += f""",
nk{s} AS MATERIALIZED (SELECT {_cols('sum(k{i}) AS n{i}')} FROM kw{s}),
rw{s} AS (SELECT id, word, n, {_cols('(d{i} + 0.2::DOUBLE) * (k{i} + 0.01::DOUBLE) / (n{i} + v * 0.01::DOUBLE) AS r{i}')} FROM tk JOIN kw{s} USING (word) JOIN dk{s} USING (id), nk{s}, vs),
nw{s} AS MATERIALIZED (SELECT id, word, n, {_cols('r{i} / (' + _cols('r{i}', ' + ').replace('{', '{{') + ') AS p{i}')} FROM rw{s}),
kw{s + 1} AS MATERIALIZED (SELECT word, {_cols('sum(n * p{i}) AS k{i}')} FROM nw{s} GROUP BY word),
dk{s + 1} AS MATERIALIZED (SELECT id, {_cols('sum(n * p{i}) AS d{i}')} FROM nw{s} GROUP BY id)"""
    parts = "[" + _cols("round(p{i}, 9)") + "]"
    return out + f""",
asg AS MATERIALIZED (SELECT id, word, n, list_position({parts}, list_max({parts})) - 1 AS topic FROM nw{SWEEPS - 1}),
mx AS MATERIALIZED (SELECT id, topic, share, row_number() OVER (PARTITION BY id ORDER BY share DESC, topic) AS rank FROM (SELECT id, topic, (sum(n) + 0.2::DOUBLE) / (sum(sum(n)) OVER (PARTITION BY id) + {K} * 0.2::DOUBLE) AS share FROM asg GROUP BY id, topic) QUALIFY rank <= 3)"""


def _folded() -> str:
    """CTE fi (id, topic, share, rank): topics of the rows of lm (id, query) under the counts of asg."""
    out = f"""wc AS MATERIALIZED (SELECT word, {_cols('sum(CASE WHEN topic = {i} THEN n ELSE 0 END)::DOUBLE AS c{i}')} FROM asg GROUP BY word), sz AS (SELECT count(*) AS v, {_cols('sum(c{i}) AS t{i}')} FROM wc),
ph AS MATERIALIZED (SELECT word, {_cols('(c{i} + 0.01::DOUBLE) / (t{i} + v * 0.01::DOUBLE) AS f{i}')} FROM wc, sz),
lt AS MATERIALIZED (SELECT id, word, count(*) AS n, {_cols('any_value(f{i}) AS f{i}')} FROM (SELECT id, unnest({semantic('query')}) AS word FROM lm) JOIN ph USING (word) GROUP BY id, word),
e0 AS (SELECT DISTINCT id, {_cols('1.0::DOUBLE AS d{i}')} FROM lt)"""
    for s in range(5):
        out += f""",
w{s} AS (SELECT id, n, {_cols('(d{i} + 0.2::DOUBLE) * f{i} AS r{i}')} FROM lt JOIN e{s} USING (id)),
e{s + 1} AS MATERIALIZED (SELECT id, {_cols('sum(n * r{i} / (' + _cols('r{i}', ' + ').replace('{', '{{') + ')) AS d{i}')} FROM w{s} GROUP BY id)"""
    total = "(" + _cols("d{i}", " + ") + ")"
    return out + f""",
fi AS MATERIALIZED (SELECT id, topic, share, row_number() OVER (PARTITION BY id ORDER BY round(share, 9) DESC, topic) AS rank FROM (SELECT id, unnest(range(0, {K})) AS topic, unnest([{_cols('(d{i} + 0.2::DOUBLE) / (' + total.replace('{', '{{') + f' + {K} * 0.2::DOUBLE)')}]) AS share FROM e5) QUALIFY rank <= 3)"""


TOPICS = f"WITH {MESSAGES}, {_topics()}"
LAST_MESSAGE = "lm AS (SELECT scope::BIGINT AS id, scope, arg_max(text, seq) AS query FROM msg GROUP BY scope)"
LINKS = "lg AS (SELECT scope, idx, unnest([lag(idx, 1) OVER w, lag(idx, 2) OVER w, lag(idx, 3) OVER w]) AS o FROM ses WINDOW w AS (PARTITION BY scope ORDER BY tick)), ln AS (SELECT scope, least(idx, o) AS a, greatest(idx, o) AS b, count(*) * 0.5::DOUBLE AS w FROM lg WHERE o IS NOT NULL AND o <> idx GROUP BY ALL)"
LINKED = f"{SESSION}, {LINKS}, bw AS MATERIALIZED (SELECT * FROM ln UNION ALL SELECT scope, b, a, w FROM ln), ew AS MATERIALIZED (SELECT scope, idx, max(weight) AS eff FROM ses GROUP BY ALL)"

SQL: dict[str, str] = {
    "vector_context": f"WITH {MESSAGES}, {CONTEXT} SELECT word, dim, val FROM cv",
    "semantic_totals": f"WITH {MESSAGES}, {CONTEXT} SELECT (SELECT count(DISTINCT word) FROM cv) AS words, (SELECT count(*) FROM sp) AS tokens, (SELECT count(DISTINCT word) FROM cv) * 1024 AS bytes",
    "vector_nearest": f"""WITH {MESSAGES}, {UNIT}, fm AS (SELECT scope, arg_min(text, seq) AS text FROM msg GROUP BY scope), qw AS (SELECT DISTINCT {semantic('text')}[1] AS qid FROM fm),
dw AS MATERIALIZED (SELECT word, list(coalesce(x, 0) ORDER BY dim) AS v FROM (SELECT DISTINCT word FROM un) CROSS JOIN range(0, 256) t(dim) LEFT JOIN un USING (word, dim) GROUP BY word),
cs AS (SELECT q.word AS qid, d.word AS id, round(list_inner_product(q.v, d.v), 9) AS cosine FROM dw q JOIN dw d ON q.word <> d.word WHERE q.word IN (SELECT qid FROM qw)),
rk AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY cosine DESC, id) AS rank FROM cs)
SELECT qid, rank, id, round(cosine, 6) AS cosine FROM rk WHERE rank <= 5""",
    "recall_semantic": f"WITH {FACT}, {LASTM}, {NEAR}, {STANDOUT} SELECT qid, idx, round(top, 6) AS cosine FROM sem",
    "recall_blended": f"""WITH {FACT}, {LASTM}, {NEAR},
bw AS (SELECT qs.qid, e.idx, len(list_filter({WORDS3}, lambda w: contains(lower(e.t), w))) AS hits FROM qs JOIN enc e USING (scope) WHERE qid IN (SELECT qid FROM eq)),
az AS (SELECT scope, idx, sum(val * CASE WHEN dim % 2 = 1 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END / 16) - 0.01::DOUBLE AS z FROM ef GROUP BY ALL),
ls AS (SELECT qid, idx, row_number() OVER (PARTITION BY qid ORDER BY hits DESC, idx) AS r FROM bw WHERE hits > 0
  UNION ALL SELECT qid, idx, row_number() OVER (PARTITION BY qid ORDER BY cosine DESC, idx) FROM nq
  UNION ALL SELECT qid, idx, row_number() OVER (PARTITION BY qid ORDER BY round(z, 9) DESC, idx) FROM nq JOIN az USING (scope, idx) WHERE z > 0),
tt AS (SELECT qid, idx, sum(1.0::DOUBLE / (60 + r)) AS score FROM ls GROUP BY ALL),
rk AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, idx) AS rank FROM tt)
SELECT qid, rank, idx, round(score, 9) AS score FROM rk WHERE rank <= 5""",
    "recall_durable": f"""WITH {FACT}, l0 AS (SELECT scope::BIGINT + 1 AS qid, arg_max(t, idx) AS query FROM enc GROUP BY scope), qs AS (SELECT qid, qid::VARCHAR AS scope, query FROM l0 WHERE qid::VARCHAR IN (SELECT scope FROM enc)),
{recall('qs')}, {TOP1}, {NEAR}, {STANDOUT}
SELECT qid, idx, round(coverage, 6) AS coverage, overlap, exact FROM top1 UNION ALL SELECT qid, idx, round(top, 6), 0, 0 FROM sem WHERE qid NOT IN (SELECT qid FROM top1)""",
    "axis_project": "WITH z AS (SELECT vec_id AS id, list_sum(list_transform(embedding::DOUBLE[], lambda y, i: y * CASE WHEN i % 2 = 1 THEN 0.125::DOUBLE ELSE -0.125::DOUBLE END)) - 0.01::DOUBLE AS z FROM embeddings) SELECT id, round(z, 9) AS z, row_number() OVER (ORDER BY z DESC, id) AS rank FROM z",
    "discriminant_classes": "WITH m AS (SELECT max(vec_id) AS top FROM embeddings) SELECT label::VARCHAR AS class, round(sum(pow(1 - 1 / 4096::DOUBLE, top - vec_id)), 6) AS weight, count(*) AS n FROM embeddings, m GROUP BY label",
    "vector_kmeans": _kmeans(8, 4),
    "spread_settled": _settled(10),
    "adaptive_session": f"{SESSION} SELECT scope, qid, idx, fact, weight, tick FROM ses",
    "adaptive_links": f"{SESSION}, {LINKS} SELECT scope, a, b, w FROM ln",
    "spread_across": f"""WITH {FACT}, ls AS (SELECT scope::BIGINT AS qid, arg_max(t, idx) AS query FROM enc GROUP BY scope), qs AS (SELECT qid, scope, query FROM ls CROSS JOIN (SELECT DISTINCT scope FROM enc)), {spread_once(5)},
fin AS (SELECT qid, scope, idx, seed, act, row_number() OVER (PARTITION BY qid ORDER BY seed DESC, round(act, 9) DESC, scope, idx) AS rank FROM rk1)
SELECT qid, rank, 'all__' || scope AS scope, idx, seed, round(act, 6) AS act FROM fin WHERE rank <= 5""",
    "spread_trusted": f"""WITH {TRUST.replace('event_type AS class', '(event_id % 100)::VARCHAR AS class')}, {FACT}, {LAST}, {spread_once(20)},
fin AS (SELECT qid, idx, act * coalesce(weight, 1.0) AS act, row_number() OVER (PARTITION BY qid ORDER BY round(act * coalesce(weight, 1.0), 9) DESC, rank) AS rank FROM rk1 LEFT JOIN ledger ON class = lower(scope))
SELECT qid, rank, idx, round(act, 6) AS act FROM fin WHERE rank <= 5""",
    "adaptive_related": f"""{LINKED},
nb AS (SELECT s.qid, s.scope, b.b AS idx, b.w, row_number() OVER (PARTITION BY s.qid, s.scope ORDER BY round(b.w * coalesce(eff, 1.0), 9) DESC, b.b) AS rank
  FROM ses s JOIN bw b ON b.scope = s.scope AND b.a = s.idx LEFT JOIN ew ON ew.scope = b.scope AND ew.idx = b.b)
SELECT qid, scope, rank, idx, round(w, 6) AS w FROM nb WHERE rank <= 3""",
    "adaptive_spread": f"""{LINKED},
e1 AS (SELECT bw.*, coalesce(eff, 1.0) AS eff, row_number() OVER (PARTITION BY bw.scope, a ORDER BY round(w * coalesce(eff, 1.0), 9) DESC, b) AS r FROM bw LEFT JOIN ew ON ew.scope = bw.scope AND ew.idx = bw.b),
ed AS MATERIALIZED (SELECT scope, a, b, 0.7::DOUBLE * w / greatest(sum(w) OVER (PARTITION BY scope, a), 1.0) * least(eff, 1.0) AS gain FROM e1 WHERE r <= 8),
h0 AS (SELECT qid, scope, idx, 1.0::DOUBLE AS act FROM ses WHERE tick = 0),
h1 AS MATERIALIZED (SELECT qid, h.scope, b AS idx, sum(act * gain) AS act FROM h0 h JOIN ed ON ed.scope = h.scope AND ed.a = h.idx WHERE act * gain > 1e-9 GROUP BY ALL),
h2 AS (SELECT qid, h.scope, b AS idx, sum(act * gain) AS act FROM h1 h JOIN ed ON ed.scope = h.scope AND ed.a = h.idx WHERE act > 1e-9 AND act * gain > 1e-9 GROUP BY ALL),
un AS (SELECT qid, scope, idx, round(sum(act), 4) AS act FROM (SELECT * FROM h0 UNION ALL SELECT * FROM h1 UNION ALL SELECT * FROM h2) GROUP BY qid, scope, idx)
SELECT *, row_number() OVER (PARTITION BY qid, scope ORDER BY act DESC, idx) AS rank FROM un QUALIFY rank <= 5""",
    "topic_mixture": f"{TOPICS} SELECT id, topic, round(share, 9) AS share, rank FROM mx",
    "topic_top_words": f"""{TOPICS}, kw AS (SELECT topic, word, sum(n) AS n FROM asg GROUP BY ALL), ph AS (SELECT topic, word, (n + 0.01::DOUBLE) / (sum(n) OVER (PARTITION BY topic) + (SELECT count(DISTINCT word) FROM kw) * 0.01::DOUBLE) AS phi FROM kw)
SELECT topic, row_number() OVER (PARTITION BY topic ORDER BY phi DESC, word) AS rank, word, round(phi, 9) AS phi FROM ph QUALIFY rank <= 8""",
    "topic_scopes": f"""{TOPICS}, n AS (SELECT scope, count(*) AS n FROM msg GROUP BY scope), p AS (SELECT DISTINCT id, topic FROM asg)
SELECT scope, topic, round(count(*) / any_value(n.n), 9) AS share FROM p JOIN tx USING (id) JOIN n USING (scope) GROUP BY scope, topic""",
    "topic_fold_in": f"{TOPICS}, {LAST_MESSAGE}, {_folded()} SELECT id, topic, round(share, 6) AS share, rank FROM fi",
    "topic_gate": f"""{TOPICS}, {LAST_MESSAGE}, {_folded()},
wt AS (SELECT word, arg_max(topic, n * 100 - topic) AS topic FROM (SELECT word, topic, sum(n) AS n FROM asg GROUP BY ALL) GROUP BY word),
wn AS (SELECT id, topic FROM (SELECT id, unnest({semantic('query')}) AS word FROM lm) JOIN wt USING (word) UNION SELECT id, topic FROM fi),
wb AS (SELECT id, topic, 0 AS loose FROM wn UNION ALL SELECT DISTINCT id, {K}, 1 FROM wn),
po AS (SELECT scope, seq AS idx, coalesce(topic, {K}) AS topic FROM tx LEFT JOIN mx USING (id)),
ht AS (SELECT wb.id, po.idx, min(loose) AS loose FROM wb JOIN lm ON lm.id = wb.id JOIN po ON po.scope = lm.scope AND po.topic = wb.topic GROUP BY ALL)
SELECT id AS qid, count(*) AS n, min(idx) AS first FROM ht GROUP BY id""",
}
