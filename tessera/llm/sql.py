"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from . import urls

OP7 = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, CASE WHEN text IS NULL THEN [] ELSE
        regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') END AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
      FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
win AS (SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS g
        FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 12) + 1)) AS i FROM b WHERE len(w) > 0)),
grams AS (SELECT r, i, n, array_to_string(w[i:i + n - 1], ' ') AS g
          FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM win) WHERE len(w) >= n)),
m AS (SELECT r, i, n, item_id FROM grams JOIN win USING (n, g)),
hit AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT r, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT r, i, n FROM m)) GROUP BY r),
its AS (SELECT r, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS s FROM m) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN its USING (r)
"""

_BASE32 = " || ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((CAST('0x' || substr(h, {5 * i + 1}, 5) AS BIGINT) >> {shift}) & 31 AS BIGINT), 1)" for i in range(8) for shift in (15, 10, 5, 0)
)
OP5 = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
q AS (SELECT page_id, strlen(html) AS payload_bytes, h, max(page_id) OVER (PARTITION BY h) AS chosen FROM p)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, {_BASE32} AS payload_digest,
       CASE WHEN page_id IS NOT DISTINCT FROM chosen THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id IS NOT DISTINCT FROM chosen THEN NULL ELSE chosen END AS refers_to
FROM q
"""

OP4 = r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, CASE WHEN text IS NULL THEN [] ELSE
        regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') END AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT r, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT r, w, unnest(range(1, greatest(1, len(w) - 4) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS MATERIALIZED (SELECT r, count(*) AS n FROM s GROUP BY r),
link AS MATERIALIZED (SELECT a, b FROM (SELECT x.r AS a, y.r AS b, count(*) AS c FROM s x JOIN s y USING (g) WHERE x.r <> y.r GROUP BY 1, 2) p
         JOIN n na ON na.r = a JOIN n nb ON nb.r = b WHERE 100 * c >= 75 * (na.n + nb.n - c)),
reach AS (SELECT r AS a, r AS b FROM d UNION SELECT reach.a, link.b FROM reach JOIN link ON link.a = reach.b)
SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(e.doc_id) AS component_id
FROM d JOIN reach ON reach.a = d.r JOIN d e ON e.r = reach.b LEFT JOIN n ON n.r = d.r GROUP BY d.r, d.doc_id
"""

OP2 = r"""
WITH m AS (SELECT row_number() OVER () AS r, conv_id, turn, role, string_split_regex(coalesce(text, ''), '\r?\n') AS lines FROM conversations),
x AS (SELECT r, conv_id, turn, i, lines[i] AS raw, len(regexp_replace(regexp_extract(lines[i], '^(?:[ \t]{0,3}>)+[ \t]?'), '[^>]', '', 'g')) AS level,
        trim(lower(regexp_replace(regexp_replace(lines[i], '^(?:[ \t]{0,3}>)+[ \t]?', ''), '\s+', ' ', 'g'))) AS line FROM (SELECT *, unnest(range(1, len(lines) + 1)) AS i FROM m)),
b AS (SELECT *, CASE WHEN coalesce(lag(line) OVER w, '') = '' OR lag(level) OVER w <> level THEN 1 ELSE 0 END AS fresh FROM x WINDOW w AS (PARTITION BY r ORDER BY i)),
k AS (SELECT *, sum(fresh) OVER (PARTITION BY r ORDER BY i) AS run FROM b WHERE line <> ''),
p AS (SELECT r, conv_id, turn, run, any_value(level) AS level, string_agg(line, ' ' ORDER BY i) AS unit FROM k GROUP BY r, conv_id, turn, run),
u AS (SELECT r, conv_id, turn, level, unit FROM p UNION SELECT r, conv_id, turn, level, line FROM k
      UNION SELECT r, conv_id, turn, 0, string_agg(unit, ' ' ORDER BY run) FROM p WHERE level = 0 GROUP BY r, conv_id, turn),
q AS (SELECT DISTINCT conv_id, turn, level, unit FROM u WHERE level > 0),
o AS (SELECT DISTINCT conv_id, turn, unit FROM u WHERE level = 0),
found AS (SELECT q.conv_id, q.turn, q.level, o.turn AS parent, count(*) AS n FROM q JOIN o ON o.conv_id = q.conv_id AND o.unit = q.unit AND o.turn < q.turn GROUP BY 1, 2, 3, 4),
links AS (SELECT conv_id, turn, parent FROM found QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY level, n DESC, parent DESC) = 1),
path AS (WITH RECURSIVE t AS (SELECT l.conv_id, l.turn, [l.turn] AS path FROM (SELECT DISTINCT conv_id, turn FROM m) l LEFT JOIN links k USING (conv_id, turn) WHERE k.parent IS NULL
         UNION ALL SELECT k.conv_id, k.turn, list_append(t.path, k.turn) FROM t JOIN links k ON k.conv_id = t.conv_id AND k.parent = t.turn) SELECT * FROM t),
f AS (SELECT m.conv_id, m.turn, m.role, (SELECT coalesce(trim(string_agg(x.raw, chr(10) ORDER BY x.i) FILTER (WHERE x.level = 0)), '') FROM x WHERE x.r = m.r) AS text,
        (SELECT count(*) FILTER (WHERE x.level > 0 AND x.line <> '') FROM x WHERE x.r = m.r) AS n_quoted, k.parent AS parent_turn, path.path
      FROM m LEFT JOIN links k USING (conv_id, turn) JOIN path ON path.conv_id IS NOT DISTINCT FROM m.conv_id AND path.turn IS NOT DISTINCT FROM m.turn)
SELECT conv_id, turn, role, text, n_quoted, parent_turn, CAST(len(path) - 1 AS BIGINT) AS depth,
       CASE WHEN conv_id IS NULL OR turn IS NULL THEN 1 ELSE row_number() OVER (PARTITION BY conv_id, turn IS NULL ORDER BY path, role, text) END AS position FROM f
"""



def _op11() -> str:
    rules = sorted(urls.RULES, key=lambda r: -len(r[1] + r[2]))
    fits = [(v, h + p, f"((host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}'))") for v, h, p in rules]
    rule, verdict = (f"CASE {' '.join(f"WHEN {c} THEN '{x[i]}'" for x in fits for c in x[2:])} END" for i in (1, 0))
    n, parts = urls.ORDER, r"(?s)^.*?://([^/?#]*)([^?#]*)"
    steps = [f"c{n} AS MATERIALIZED (SELECT g, coalesce(sum(n) FILTER (WHERE part = 'train allow'), 0) AS a, coalesce(sum(n) FILTER (WHERE part = 'train block'), 0) AS r FROM place GROUP BY g)"]
    steps += [f"c{k} AS MATERIALIZED (SELECT substr(g, 2) AS g, sum(a) AS a, sum(r) AS r FROM c{k + 1} GROUP BY 1)" for k in reversed(range(n))]
    for k in range(n + 1):
        shorter = f"JOIN p{k - 1} q ON q.g = substr(c.g, 2)" if k else "CROSS JOIN (SELECT 1.0::DOUBLE / (count(*) + 1) AS pa, 1.0::DOUBLE / (count(*) + 1) AS pr FROM c0) q"
        chance = lambda c: f"CASE WHEN c{c} > 0 THEN ({c} + t{c} * q.p{c}) / (c{c} + t{c})::DOUBLE ELSE q.p{c} END AS p{c}"
        steps.append(f"""p{k} AS MATERIALIZED (SELECT c.g, {chance("a")}, {chance("r")} FROM (SELECT *, sum(a) OVER w AS ca, count(*) FILTER (WHERE a > 0) OVER w AS ta, sum(r) OVER w AS cr,
            count(*) FILTER (WHERE r > 0) OVER w AS tr FROM c{k} WINDOW w AS (PARTITION BY substr(g, 1, {k}))) c {shorter})""")
    return f"""
WITH h AS (SELECT page_id, coalesce(url, '') AS u, translate(regexp_extract(coalesce(url, ''), '{parts}', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '{parts}', 2) AS path FROM pages),
ruled AS MATERIALIZED (SELECT *, {rule} AS rule, {verdict} AS by_rule FROM h),
u AS MATERIALIZED (SELECT u, CASE WHEN by_rule IS NULL THEN 'judge' WHEN substr(md5(u), 1, 1) IN ('0', '1', '2') THEN 'test ' || by_rule ELSE 'train ' || by_rule END AS part, count(*) AS n FROM ruled GROUP BY 1, 2),
place AS MATERIALIZED (SELECT u, part, n, substr(repeat(chr(2), {n}) || u || chr(3), i, {n + 1}) AS g FROM (SELECT *, unnest(range(1, length(u) + 2)) AS i FROM u)),
{", ".join(steps)},
score AS MATERIALIZED (SELECT u, part, n, CAST(floor(sum(CAST(round((ln(pa) - ln(pr)) * {urls.NAT}) AS BIGINT)) / count(*)) AS BIGINT) AS score FROM place JOIN p{n} USING (g) WHERE part NOT LIKE 'train%' GROUP BY u, part, n),
bin AS (SELECT floor(score / {urls.BIN}) AS b, coalesce(sum(n) FILTER (WHERE part = 'test allow'), 0) AS a, coalesce(sum(n) FILTER (WHERE part = 'test block'), 0) AS r FROM score WHERE part <> 'judge' GROUP BY 1),
above AS (SELECT b, coalesce(lead(b) OVER w + 1, b) AS e, sum(a) OVER w AS a, sum(r) OVER w AS r, sum(a) OVER () AS na, sum(r) OVER () AS nr FROM bin WINDOW w AS (ORDER BY b DESC)),
least AS (SELECT coalesce((SELECT (b + e) * {urls.BIN // 2} FROM above WHERE na > 0 AND nr > 0 ORDER BY a::DOUBLE / na - r::DOUBLE / nr DESC, b LIMIT 1), 0) AS t)
SELECT page_id, host, path, rule, coalesce(by_rule, CASE WHEN score >= t THEN 'allow' ELSE 'block' END) AS verdict
FROM ruled LEFT JOIN (SELECT u, score FROM score WHERE part = 'judge') s USING (u) CROSS JOIN least
"""


OP12 = """
WITH e AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST) AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda c: floor(256 * c::DOUBLE)) AS x FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
s AS MATERIALIZED (SELECT a.r AS ar, a.vec_id AS anchor_id, a.label = b.label AS own, b.r, b.vec_id, CAST(list_inner_product(a.x, b.x) AS BIGINT) AS s FROM e a JOIN e b ON b.r <> a.r WHERE a.vec_id % 50 = 0),
p AS (SELECT ar, anchor_id, r, vec_id AS positive_id, s AS positive_score FROM s WHERE own QUALIFY row_number() OVER (PARTITION BY ar ORDER BY s DESC, r) <= 5)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, s.vec_id AS negative_id, positive_score, s.s AS negative_score
FROM p JOIN s ON s.ar = p.ar AND NOT s.own AND 50 * positive_score <= 100 * s.s AND 100 * s.s <= 95 * positive_score
WINDOW w AS (PARTITION BY p.ar, p.r ORDER BY s.s DESC, s.r) QUALIFY rank <= 3
"""

SQL = {"op11_url_language_models": _op11(), "op12_hard_negatives": OP12, "op2_quotation_linking": OP2, "op4_jaccard_join": OP4, "op5_warc": OP5, "op7_decontamination": OP7}
