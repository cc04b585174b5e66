"""DuckDB SQL of the corpus queries that SQL can express."""

from __future__ import annotations

from .license_scan import AGREE, ANCHORS, BASE_PHRASES, NON_WORD, TEMPLATES, least_words, tolerance
from .mixing import SCALE
from .secret_scan import BASE_RULES, RULES
from .url_filter import HOST_PATH, MarkovConfig
from .url_filter import RULES as URL_RULES


def _text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def licence_sql() -> str:
    words = ", ".join(f"({i}, {p}, {_text(w)})" for i, t in enumerate(TEMPLATES) for p, w in enumerate(t.words))
    keys = ", ".join(f"({i}, {_text(k)})" for i, t in enumerate(TEMPLATES) for k in t.keys)
    labels = ", ".join(f"({i}, {_text(t.label)}, {len(t.words)}, {len(set(t.words))}, {least_words(t)}, {tolerance(t)})" for i, t in enumerate(TEMPLATES))
    parts = [(p.split(), label) for p, label in BASE_PHRASES.items()]
    base = " UNION ALL ".join(
        f"SELECT doc_id, pos, {_text(label)} AS label FROM w WHERE word = {_text(ws[0])} AND n1 = {_text(ws[1])}" + (f" AND n2 = {_text(ws[2])}" if len(ws) > 2 else "") for ws, label in parts
    )
    return f"""WITH d AS (SELECT doc_id, trim(regexp_replace(lower(coalesce(text, '')), {_text(NON_WORD)}, ' ', 'g')) AS norm FROM documents),
 l AS (SELECT doc_id, norm, CASE WHEN norm = '' THEN [] ELSE string_split(norm, ' ') END AS ws FROM d),
 u AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) - 1 AS pos FROM l),
 w AS (SELECT *, lead(word) OVER (PARTITION BY doc_id ORDER BY pos) AS n1, lead(word, 2) OVER (PARTITION BY doc_id ORDER BY pos) AS n2 FROM u),
 base AS ({base}),
 tw(t, p, word) AS (VALUES {words}), tk(t, phrase) AS (VALUES {keys}), tl(t, label, n, kinds, least, wide) AS (VALUES {labels}),
 h AS (SELECT * FROM u WHERE word IN (SELECT word FROM tw)),
 df AS (SELECT word, count(DISTINCT doc_id) AS df FROM h GROUP BY word),
 have AS (SELECT doc_id, t, word, row_number() OVER (PARTITION BY doc_id, t ORDER BY df, word) AS r, count(*) OVER (PARTITION BY doc_id, t) AS have FROM (SELECT DISTINCT doc_id, word FROM h) JOIN (SELECT DISTINCT t, word FROM tw) USING (word) JOIN df USING (word)),
 anchors AS (SELECT doc_id, t, word, greatest(least(2, least(have, {ANCHORS})), (least(have, {ANCHORS}) * {round(AGREE * 10)} + 9) // 10) AS need FROM have JOIN tl USING (t) WHERE have >= least AND r <= {ANCHORS}),
 votes AS (SELECT doc_id, t, need, d, row_number() OVER (PARTITION BY doc_id, t ORDER BY d, word) AS r FROM (SELECT DISTINCT a.doc_id, a.t, a.need, h.pos - tw.p AS d, a.word FROM anchors a JOIN h ON h.doc_id = a.doc_id AND h.word = a.word JOIN tw ON tw.t = a.t AND tw.word = a.word)),
 starts AS (SELECT DISTINCT x.doc_id, x.t, x.d FROM votes x JOIN votes y ON y.doc_id = x.doc_id AND y.t = x.t AND y.r = x.r + x.need - 1 JOIN tl ON tl.t = x.t WHERE y.d - x.d <= wide),
 there AS (SELECT s.doc_id, s.t, s.d, count(DISTINCT h.word) AS found FROM starts s JOIN tl USING (t) JOIN h ON h.doc_id = s.doc_id AND h.pos >= s.d - wide AND h.pos < s.d + n + wide JOIN (SELECT DISTINCT t, word FROM tw) k ON k.t = s.t AND k.word = h.word GROUP BY s.doc_id, s.t, s.d),
 ok AS (SELECT x.doc_id, x.t, x.d, found FROM there x JOIN tl USING (t) JOIN l ON l.doc_id = x.doc_id WHERE found >= least
   AND NOT EXISTS (SELECT 1 FROM tk WHERE tk.t = x.t AND NOT contains(' ' || array_to_string(ws[greatest(0, x.d - wide) + 1:x.d + n + wide], ' ') || ' ', ' ' || tk.phrase || ' '))),
 shares AS (SELECT doc_id, label, arg_min(found, d)::DOUBLE / kinds AS share FROM ok JOIN tl USING (t) GROUP BY doc_id, t, label, kinds),
 b AS (SELECT doc_id, count(*) AS n_base, min(pos) AS first_word, max(pos) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM base GROUP BY doc_id),
 a AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT doc_id, label FROM base UNION SELECT doc_id, label FROM shares) GROUP BY doc_id),
 m AS (SELECT doc_id, max(share) AS share FROM shares GROUP BY doc_id)
 SELECT l.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_base, 0) AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word, coalesce(b.labels, '') AS base_labels, coalesce(a.labels, '') AS labels, CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(share, 0.0)::DOUBLE END AS score
 FROM l LEFT JOIN b USING (doc_id) LEFT JOIN a USING (doc_id) LEFT JOIN m USING (doc_id)"""


def secret_sql() -> str:
    parts = []
    for no, r in enumerate(RULES):
        parts.append(
            f"""SELECT doc_id, {no} AS no, {_text(r.kind)} AS kind, unnest(ms) AS m, unnest(ks) AS k, unnest(list_transform(range(1, len(ms) + 1), lambda i: list_sum(list_transform(ms[:i], lambda x: length(x))) + list_sum(list_transform(ps[:i], lambda x: length(x)))))::BIGINT AS e
 FROM (SELECT doc_id, regexp_extract_all(t, {_text(r.pattern)}) AS ms, regexp_extract_all(t, {_text(r.pattern)}, {r.group}) AS ks, regexp_split_to_array(t, {_text(r.pattern)}) AS ps FROM d WHERE regexp_matches(t, {_text(r.pattern)}))"""
        )
    found = " UNION ALL ".join(f"(SELECT doc_id, no, kind, e - length(m) AS s, e FROM ({p}) WHERE length(k) >= {r.least})" for p, r in zip(parts, RULES, strict=True))
    base = ", ".join(_text(r.kind) for r in BASE_RULES)
    joined = "coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, no){0}, '')"
    counts = ", ".join(f"count(kind) FILTER (WHERE kind = {_text(r.kind)}) AS n_{r.kind}" for r in BASE_RULES)
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), f AS ({found})
 SELECT d.doc_id, {counts}, sha256({joined.format(f" FILTER (WHERE kind IN ({base}))")}) AS base_sha256, {joined.format('')} AS spans FROM d LEFT JOIN f USING (doc_id) GROUP BY d.doc_id"""


MIXING = f"""WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
   (('0x' || substring(md5('mix|' || coalesce(doc_id::VARCHAR, '') || '|' || md5(coalesce(text, ''))), 1, 13))::BIGINT + 0.5::DOUBLE) / {SCALE}.0::DOUBLE AS u FROM documents),
 s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
 w AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight, source_size * 2.0::DOUBLE AS most FROM s),
 r AS (SELECT *, (sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE - coalesce(sum(most) OVER o, 0) AS words, sum(weight) OVER () - coalesce(sum(weight) OVER o, 0) AS others FROM w WINDOW o AS (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
 v AS (SELECT *, CASE WHEN most * others > weight * words THEN words / others END AS level FROM r),
 t AS (SELECT source, source_size, coalesce(weight * first_value(level IGNORE NULLS) OVER (ORDER BY most / weight, source NULLS LAST ROWS UNBOUNDED PRECEDING), most) AS target FROM v),
 e AS (SELECT d.*, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS expected FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
 q AS (SELECT *, expected - floor(expected) AS share, (u / (1 - u)) / nullif((expected - floor(expected)) / (1 - (expected - floor(expected))), 0) AS q FROM e),
 k AS (SELECT *, least(floor(q / (1 + q) * {SCALE}.0::DOUBLE), {SCALE - 1}) AS rank FROM q WHERE share > 0),
 g AS (SELECT source, rank, any_value(target - floor(expected) * source_size) AS need, sum(size)::BIGINT AS size FROM k GROUP BY source, rank),
 c AS (SELECT source, max(rank) AS cut FROM (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY rank ROWS UNBOUNDED PRECEDING) - size / 2 AS middle FROM g) WHERE middle < need GROUP BY source),
 x AS (SELECT e.*, floor(e.expected)::BIGINT + CASE WHEN k.rank <= c.cut THEN 1 ELSE 0 END AS copies FROM e LEFT JOIN k ON k.doc_id IS NOT DISTINCT FROM e.doc_id AND k.u = e.u LEFT JOIN c ON c.source IS NOT DISTINCT FROM e.source)
 SELECT doc_id, size, source_size, target, (copies * size)::BIGINT AS taken, copies::BIGINT AS copies FROM x"""

WARC = """WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS n, sha256(coalesce(html, '')) AS digest FROM pages), q AS (SELECT *, n >= 100 AND min(page_id) OVER (PARTITION BY digest) <> page_id AS again, min(page_id) OVER (PARTITION BY digest) AS f FROM p)
 SELECT page_id, n AS payload_bytes, digest AS payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN f END AS refers_to FROM q"""

NEAR = """WITH RECURSIVE t AS (SELECT text, min(doc_id) AS id FROM documents WHERE text IS NOT NULL GROUP BY text),
 w AS (SELECT id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+') AS ws FROM t),
 s AS (SELECT id, unnest(list_transform(range(1, greatest(1, len(ws) - 4) + 1), lambda i: array_to_string(ws[i:i + 4], ' '))) AS shingle FROM w WHERE len(ws) > 0),
 b AS (SELECT id, shingle, row_number() OVER (PARTITION BY id, shingle) AS again FROM s), n AS (SELECT id, count(*) AS n FROM b GROUP BY id),
 links AS (SELECT x.id AS a, y.id AS b FROM b x JOIN b y ON x.shingle = y.shingle AND x.again = y.again AND x.id <> y.id JOIN n nx ON nx.id = x.id JOIN n ny ON ny.id = y.id
   WHERE least(nx.n, ny.n) >= 0.8 * greatest(nx.n, ny.n) - 1e-9 GROUP BY x.id, y.id, nx.n, ny.n HAVING count(*) >= 0.8 * (nx.n + ny.n - count(*)) - 1e-9),
 reach(a, root) AS (SELECT id, id FROM t UNION SELECT l.a, r.root FROM links l JOIN reach r ON r.a = l.b WHERE r.root < l.a),
 c AS (SELECT a AS id, min(root) AS class_id FROM reach GROUP BY a)
 SELECT d.doc_id, coalesce(c.class_id, d.doc_id) AS class_id FROM documents d LEFT JOIN t ON t.text = d.text LEFT JOIN c ON c.id = t.id"""



def url_sql() -> str:
    """Fitted and calibrated on all labelled URLs."""
    c, k = MarkovConfig(), MarkovConfig().order + 1
    rules = sorted(URL_RULES, key=lambda r: (-len(r.name), r.name))
    fits = [f"(host = {_text(r.host)} OR ends_with(host, {_text('.' + r.host)})) AND starts_with(path, {_text(r.path)})" for r in rules]
    rule = "CASE " + " ".join(f"WHEN {f} THEN {_text(r.name)}" for f, r in zip(fits, rules, strict=True)) + " END"
    verdict = "CASE rule " + " ".join(f"WHEN {_text(r.name)} THEN {_text(r.verdict)}" for r in rules) + " END"
    padded = f"repeat(chr(2), {c.order}) || lower(url) || chr(3)"

    def probability(x: str) -> str:
        p = f"(1.0::DOUBLE / {c.alphabet})"
        for j in range(1, k + 1):
            total, kinds = f"coalesce(h{j}.c{x}, 0)", f"coalesce(h{j}.t{x}, 0)"
            p = f"(CASE WHEN {total} > 0 THEN (coalesce(g{j}.{x}, 0) + {kinds} * {p}) / ({total} + {kinds}) ELSE {p} END)"
        return p

    joins = " ".join(f"LEFT JOIN cnt g{j} ON g{j}.g = substring(s, i - {j - 1}, {j}) LEFT JOIN ctx h{j} ON h{j}.h = substring(s, i - {j - 1}, {j - 1})" for j in range(1, k + 1))
    grams = ", ".join(f"substring(s, i - {j - 1}, {j})" for j in range(1, k + 1))
    return f"""WITH b AS (SELECT page_id, url, translate(coalesce(regexp_extract(url, {_text(HOST_PATH)}, 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, coalesce(regexp_extract(url, {_text(HOST_PATH)}, 2), '') AS path FROM pages),
 u AS (SELECT *, {rule} AS rule FROM b),
 lab AS (SELECT DISTINCT url, {verdict} = 'allow' AS accepted, ('0x' || substring(md5(url), 1, 8))::BIGINT % 4 AS fold FROM u WHERE rule IS NOT NULL),
 urls AS (SELECT url, s, unnest(range({k}, length(s) + 1)) AS i FROM (SELECT DISTINCT url, {padded} AS s FROM pages WHERE url IS NOT NULL)),
 cnt AS (SELECT g, count(*) FILTER (WHERE accepted) AS a, count(*) FILTER (WHERE NOT accepted) AS r FROM (SELECT accepted, unnest([{grams}]) AS g FROM urls JOIN lab USING (url) WHERE fold <> 0) GROUP BY g),
 ctx AS (SELECT substring(g, 1, length(g) - 1) AS h, sum(a)::DOUBLE AS ca, count(*) FILTER (WHERE a > 0) AS ta, sum(r)::DOUBLE AS cr, count(*) FILTER (WHERE r > 0) AS tr FROM cnt GROUP BY 1),
 sc AS (SELECT url, avg(ln({probability("a")}) - ln({probability("r")})) AS score FROM urls {joins} GROUP BY url),
 held AS (SELECT score, count(*) FILTER (WHERE accepted) AS a, count(*) FILTER (WHERE NOT accepted) AS r FROM sc JOIN lab USING (url) WHERE fold = 0 GROUP BY score),
 gain AS (SELECT score, (sum(r) OVER o - r) / sum(r) OVER () - (sum(a) OVER o - a) / sum(a) OVER () AS gain, (score + coalesce(lag(score) OVER (ORDER BY score), score)) / 2 AS cut FROM held WINDOW o AS (ORDER BY score ROWS UNBOUNDED PRECEDING)),
 cut AS (SELECT coalesce((SELECT cut FROM gain WHERE gain IS NOT NULL ORDER BY gain DESC, score LIMIT 1), 0) AS cut)
 SELECT page_id, host, path, rule, coalesce({verdict}, CASE WHEN score < cut THEN 'block' ELSE 'allow' END) AS verdict, round(score, 6) AS score FROM u LEFT JOIN sc USING (url), cut"""


ORACLES: dict[str, str] = {
    "op1_url_markov_ratio": url_sql(),
    "op4_license_rare_tokens": licence_sql(),
    "op5_secret_trigrams": secret_sql(),
    "op8_pareto_mixing": MIXING,
    "op9_warc_index": WARC,
    "op10_bagminhash_near_dups": NEAR,
}
