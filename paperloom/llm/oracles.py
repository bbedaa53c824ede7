"""DuckDB SQL of the operators that SQL can express, written independently of the Spark plans (plain and quadratic)."""

_WORD = r"[^\x20\x09-\x0D]+"

#: Smallest reachable id over edges e(a, b) in both directions.
_REACH = """reach(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM reach r JOIN e ON r.b = e.a),
  low AS (SELECT a, min(b) AS m FROM reach GROUP BY a)"""

OP2 = f"""WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda y: y IS NULL OR NOT isfinite(y))) = 0 AND len(list_filter(embedding, lambda y: y <> 0)) > 0),
  e AS MATERIALIZED (SELECT p.vec_id AS a, q.vec_id AS b FROM v p JOIN v q ON p.label = q.label AND p.vec_id <> q.vec_id AND len(p.x) = len(q.x) AND list_cosine_similarity(p.x, q.x) >= 0.98),
  {_REACH}
  SELECT v.vec_id, coalesce(d.n, 0)::BIGINT AS n_links, least(coalesce(low.m, v.vec_id), v.vec_id) AS component_id, least(coalesce(low.m, v.vec_id), v.vec_id) = v.vec_id AS kept
  FROM embeddings v LEFT JOIN (SELECT a, count(*) AS n FROM e GROUP BY a) d ON d.a = v.vec_id LEFT JOIN low ON low.a = v.vec_id"""

OP3 = f"""WITH sized AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{_WORD}'))::BIGINT AS size FROM documents),
  src AS (SELECT source, sum(size)::BIGINT AS ss, count(*) AS docs, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w,
    row_number() OVER (ORDER BY source NULLS LAST) AS rk FROM sized GROUP BY source),
  lv AS (SELECT *, 2 * (ss / w) AS ratio, (1.5::DOUBLE * sum(ss) OVER () - 2 * coalesce(sum(ss) OVER o, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER o, 0)) AS level
    FROM src WINDOW o AS (ORDER BY 2 * (ss / w), rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
  water AS (SELECT arg_min(level, (ratio, rk)) AS level FROM lv WHERE ratio >= level),
  tg AS (SELECT source, ss, docs, coalesce(least((2 * ss)::DOUBLE, w * (SELECT level FROM water)), (2 * ss)::DOUBLE) AS target, rk FROM src),
  n AS (SELECT round(sum(target) / 32)::BIGINT AS seats, count(*) AS items, sum(target) AS votes FROM tg),
  c AS (SELECT tg.rk, target / (2 * s + 1) AS quotient, s FROM (SELECT tg.rk, tg.target, unnest(range(0, ceil(tg.target * n.seats / n.votes)::BIGINT + n.items + 3)) AS s FROM tg, n WHERE n.votes > 0) tg),
  won AS (SELECT rk, count(*) AS blocks FROM (SELECT rk, row_number() OVER (ORDER BY quotient DESC, rk, s) AS r FROM c WHERE quotient > 0) WHERE r <= (SELECT seats FROM n) GROUP BY rk),
  placed AS (SELECT d.doc_id, d.size, tg.rk, tg.ss, tg.target, md5('mix' || coalesce(':' || d.doc_id, '') || ':' || d.size) AS place, ('0x' || substring(md5('mix' || coalesce(':' || d.doc_id, '') || ':' || d.size), 1, 8))::BIGINT % ceil(tg.docs / 2000)::BIGINT AS shard,
    coalesce(won.blocks, 0) AS blocks FROM sized d JOIN tg ON d.source IS NOT DISTINCT FROM tg.source LEFT JOIN won ON won.rk = tg.rk),
  sh AS (SELECT rk, shard, sum(size) AS z, any_value(blocks) AS blocks, sum(sum(size)) OVER (PARTITION BY rk) AS zs, count(*) OVER (PARTITION BY rk) AS k FROM placed GROUP BY rk, shard),
  sc AS (SELECT rk, shard, blocks, z / (2 * s + 1) AS quotient, s FROM (SELECT *, unnest(range(0, ceil(z * blocks / zs)::BIGINT + k + 3)) AS s FROM sh WHERE z > 0)),
  swon AS (SELECT rk, shard, count(*) AS seats FROM (SELECT *, row_number() OVER (PARTITION BY rk ORDER BY quotient DESC, shard, s) AS r FROM sc) WHERE r <= blocks GROUP BY rk, shard),
  q AS (SELECT p.*, sh.z, least(coalesce(swon.seats, 0) * 32, 2 * sh.z)::BIGINT AS quota, coalesce(sum(p.size) OVER (PARTITION BY p.rk, p.shard ORDER BY p.place, p.doc_id NULLS LAST, p.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
    FROM placed p JOIN sh ON sh.rk = p.rk AND sh.shard = p.shard LEFT JOIN swon ON swon.rk = p.rk AND swon.shard = p.shard)
  SELECT doc_id, size, ss AS source_size, target, (CASE WHEN z > 0 THEN quota // z ELSE 0 END * size + greatest(0, least(size, quota - CASE WHEN z > 0 THEN quota // z ELSE 0 END * z - before)))::BIGINT AS taken FROM q"""

OP4 = f"""WITH RECURSIVE w AS MATERIALIZED (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORD}') AS w FROM documents),
  k AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS p, len(w) AS n FROM w),
  l AS (SELECT doc_id, p, n, x || ' ' || lead(x, 1) OVER o || ' ' || lead(x, 2) OVER o || ' ' || lead(x, 3) OVER o AS g FROM k WINDOW o AS (PARTITION BY doc_id ORDER BY p)),
  s AS MATERIALIZED (SELECT DISTINCT doc_id, g FROM l WHERE n >= 4 AND p <= n - 3 UNION SELECT doc_id, array_to_string(w, ' ') FROM w WHERE len(w) BETWEEN 1 AND 3),
  z AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
  c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
  h AS MATERIALIZED (SELECT c.a, c.b FROM c JOIN z x ON x.doc_id = c.a JOIN z y ON y.doc_id = c.b WHERE 100 * i >= 85 * (x.n + y.n - i)),
  e AS MATERIALIZED (SELECT a, b FROM h UNION ALL SELECT b, a FROM h), {_REACH}
  SELECT d.doc_id, coalesce(z.n, 0)::BIGINT AS n_shingles, least(coalesce(low.m, d.doc_id), d.doc_id) AS component_id FROM documents d LEFT JOIN z USING (doc_id) LEFT JOIN low ON low.a = d.doc_id"""

_LEADS = ", ".join(["x", *[f"lead(x, {j}) OVER o" for j in range(1, 20)]])

OP9 = f"""WITH w AS MATERIALIZED (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM documents),
  k AS MATERIALIZED (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS p, len(w) AS n FROM w),
  g AS (SELECT doc_id, p, n, concat_ws(' ', {_LEADS}) AS g FROM k WINDOW o AS (PARTITION BY doc_id ORDER BY p)),
  r AS (SELECT doc_id, p FROM g WHERE p <= n - 19 QUALIFY row_number() OVER (PARTITION BY g ORDER BY doc_id, p) > 1),
  c AS (SELECT DISTINCT doc_id, unnest(range(p, p + 20)) AS p FROM r),
  t AS (SELECT k.doc_id, count(c.p) AS gone, string_agg(k.x, ' ' ORDER BY k.p) FILTER (c.p IS NULL) AS kept FROM k LEFT JOIN c ON c.doc_id = k.doc_id AND c.p = k.p GROUP BY k.doc_id)
  SELECT w.doc_id, len(w.w)::BIGINT AS n_words, coalesce(t.gone, 0)::BIGINT AS n_removed, sha256(coalesce(t.kept, '')) AS kept_sha256 FROM w LEFT JOIN t USING (doc_id)"""

OP10 = """WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages), f AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first FROM p)
  SELECT page_id, strlen(h)::BIGINT AS payload_bytes, sha256(h) AS payload_digest, CASE WHEN strlen(h) >= 100 AND first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN strlen(h) >= 100 AND first <> page_id THEN first END AS refers_to FROM f"""

#: Bytes are pairs of hexadecimal digits; removed runs are joined, and what lies between them is kept.
OP11 = """WITH d AS MATERIALIZED (SELECT doc_id, strlen(coalesce(text, '')) AS n, hex(encode(coalesce(text, ''))) AS h FROM documents),
  g AS (SELECT doc_id, p, md5(substring(h, 2 * p + 1, 200)) AS g FROM (SELECT doc_id, h, unnest(range(0, n - 99)) AS p FROM d)),
  r AS (SELECT doc_id, p FROM g QUALIFY row_number() OVER (PARTITION BY g ORDER BY doc_id, p) > 1),
  i AS (SELECT doc_id, p, p > coalesce(max(p) OVER o, -1000) + 100 AS new FROM r WINDOW o AS (PARTITION BY doc_id ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
  s AS (SELECT doc_id, k, min(p) AS a, max(p) + 100 AS b FROM (SELECT *, sum(new::INT) OVER (PARTITION BY doc_id ORDER BY p) AS k FROM i) GROUP BY doc_id, k),
  t AS (SELECT s.doc_id, a, b, coalesce(lag(b) OVER o, 0) AS z, d.n, h, lead(a) OVER o IS NULL AS last FROM s JOIN d USING (doc_id) WINDOW o AS (PARTITION BY s.doc_id ORDER BY a)),
  k AS (SELECT doc_id, sum(b - a)::BIGINT AS gone, count(*) AS spans, string_agg(substring(h, 2 * z + 1, 2 * (a - z)) || CASE WHEN last THEN substring(h, 2 * b + 1) ELSE '' END, '' ORDER BY a) AS h FROM t GROUP BY doc_id)
  SELECT d.doc_id, d.n::BIGINT AS n_bytes, coalesce(k.gone, 0)::BIGINT AS n_removed, coalesce(k.spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(k.h, d.h))) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)"""


def _assign(k: int) -> str:
    """Entry and distance of each part against the codebook b<k>."""
    return f"""a{k} AS MATERIALIZED (SELECT vec_id, p, min(far)::BIGINT AS far, arg_min(e, (far, e)) AS e FROM (SELECT x.vec_id, x.p, b.e, list_sum(list_transform(list_zip(x.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS far
    FROM parts x JOIN b{k} b ON b.p = x.p) GROUP BY vec_id, p)"""


def _move(k: int) -> str:
    """Codebook b<k + 1> from b<k>: floors of the means, unused entries as they were."""
    floor = "((s - ((s % n) + n) % n) // n)"
    return f"""b{k + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(m.x, b.x) AS x FROM b{k} b LEFT JOIN (SELECT p, e, list({floor}::BIGINT ORDER BY j) AS x FROM
    (SELECT a.p, a.e, j, sum(x.x[j])::BIGINT AS s, count(*)::BIGINT AS n FROM a{k} a JOIN parts x ON x.vec_id = a.vec_id AND x.p = a.p, (SELECT unnest(range(1, (SELECT max(len(x)) FROM parts) + 1)) AS j) GROUP BY 1, 2, 3) GROUP BY p, e) m ON m.p = b.p AND m.e = b.e)"""


OP12 = f"""WITH v AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda y: floor(256 * y::DOUBLE)::BIGINT) AS x FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda y: y IS NULL OR NOT isfinite(y))) = 0),
  parts AS MATERIALIZED (SELECT vec_id, p, x[p * len(x) // 16 + 1 : (p + 1) * len(x) // 16] AS x FROM v, (SELECT unnest(range(0, 16)) AS p)),
  b0 AS MATERIALIZED (SELECT p, dense_rank() OVER (ORDER BY vec_id) - 1 AS e, x FROM parts WHERE vec_id IN (SELECT vec_id FROM v ORDER BY vec_id LIMIT 64)),
  {_assign(0)}, {_move(0)}, {_assign(1)}, {_move(1)}, {_assign(2)},
  coded AS (SELECT vec_id, string_agg(lower(printf('%02x', e)), '' ORDER BY p) AS code, sum(far)::BIGINT AS error FROM a2 GROUP BY vec_id),
  book AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY p, e)) AS h FROM b2)
  SELECT c.vec_id, c.code, c.error, (sum(c.error) OVER (PARTITION BY v.label))::BIGINT AS label_error, book.h AS codebooks_sha256 FROM coded c JOIN v USING (vec_id), book"""
