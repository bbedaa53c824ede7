"""Joins, set operations, validation rules and the composed pipeline."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import assign, dedupe, facts, lines as L, matching as M, plugins, ranking, rules as R
from ..session import written
from ..sources.tables import Tables
from ..streaming.events import sessionize, windowed
from .registry import LINE, key, query, score, squash

_ENT = "list_distinct(list_filter(string_split(trim(regexp_replace(lower({0}), '[^a-z0-9]+', ' ', 'g')), ' '), lambda w: length(w) > 2 AND w NOT IN ('inc','llc','ltd','limited','corp','corporation','co','company','gmbh','pvt','private')))"


def _long(c: F.Column) -> F.Column:
    return c.cast("long")


_ENT_KEY = "array_to_string(list_filter(string_split(trim(regexp_replace(lower({0}), '[^a-z0-9]+', ' ', 'g')), ' '), lambda w: w NOT IN ('inc','llc','ltd','limited','corp','corporation','co','company','gmbh','pvt','private')), ' ')"


@query(f"""WITH a AS (SELECT DISTINCT p_name AS l FROM part), b AS (SELECT DISTINCT p_name || ' ' || p_type || ' inc' AS r FROM part),
  x AS (SELECT l, {_ENT.format("l")} AS t, {_ENT_KEY.format("l")} AS k FROM a), y AS (SELECT r, {_ENT.format("r")} AS t, {_ENT_KEY.format("r")} AS k FROM b),
  m AS (SELECT l, r, len(list_intersect(x.t, y.t)) AS common, CASE WHEN x.k <> '' AND y.k <> '' AND (contains(' ' || x.k || ' ', ' ' || y.k || ' ') OR contains(' ' || y.k || ' ', ' ' || x.k || ' ')) THEN 1.0::DOUBLE
    ELSE len(list_intersect(x.t, y.t)) / least(len(x.t), len(y.t)) END AS share FROM x, y)
  SELECT p_partkey, r, share FROM m JOIN part ON p_name = l WHERE share >= 0.6 AND (common > 0 OR share = 1)""")
def entity_match(t: Tables) -> DataFrame:
    """All parts against all labelled names; distinct names are matched and the parts joined to them."""
    right = t.part.select(F.concat_ws(" ", "p_name", "p_type", F.lit("inc")).alias("r"))
    found = M.entity_pairs(t.part.select(F.col("p_name").alias("l")), right)
    return t.part.select("p_partkey", F.col("p_name").alias("l")).join(found, "l").select("p_partkey", "r", "share")


@query(f"""WITH a AS (SELECT s_suppkey AS l, s_name AS name FROM supplier), b AS (SELECT c_custkey AS r, c_name AS name FROM customer),
  x AS (SELECT l, unnest({_ENT.format("name")}) AS t FROM a), y AS (SELECT DISTINCT unnest({_ENT.format("name")}) AS t FROM b)
  SELECT s_suppkey, s_name FROM supplier WHERE s_suppkey NOT IN (SELECT l FROM x JOIN y USING (t) GROUP BY l HAVING count(*) >= 2)""")
def unmatched_entities(t: Tables) -> DataFrame:
    """Suppliers without two name tokens in common with any customer."""
    x = t.supplier.select("s_suppkey", F.explode(M.entity_tokens(F.col("s_name"))).alias("t"))
    y = t.customer.select(F.explode(M.entity_tokens(F.col("c_name"))).alias("t")).distinct()
    hit = x.join(y, "t", "left_semi").groupBy("s_suppkey").agg(F.count(F.lit(1)).alias("n")).where("n >= 2")
    return t.supplier.join(hit, "s_suppkey", "left_anti").select("s_suppkey", "s_name")


@query("""WITH f AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_totalprice > 300000)
  SELECT k AS c_custkey, 'found' AS origin FROM f UNION ALL SELECT c_custkey, 'backfilled' FROM customer WHERE c_custkey NOT IN (SELECT k FROM f)""")
def anti_backfill(t: Tables) -> DataFrame:
    found = t.orders.where("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey")).distinct()
    return M.backfill(found, t.customer.select("c_custkey"), "c_custkey")


@query("""WITH k AS (SELECT n_nationkey, n_name FROM nation WHERE n_nationkey IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 9000))
  SELECT * FROM k UNION ALL SELECT n_nationkey, n_name FROM nation WHERE NOT EXISTS (SELECT 1 FROM k)""")
def semi_with_fallback(t: Tables) -> DataFrame:
    n = t.nation.select("n_nationkey", "n_name")
    rich = t.supplier.where("s_acctbal > 9000").select(F.col("s_nationkey").alias("n_nationkey")).distinct()
    return M.semi_or_all(n, rich, "n_nationkey")


@query("""WITH v AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS token FROM part WHERE p_size > 40), t AS (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS token FROM part)
  SELECT p_partkey, string_agg(token, ',' ORDER BY token) AS grounded FROM t WHERE token IN (SELECT token FROM v) GROUP BY p_partkey""")
def grounded_tokens(t: Tables) -> DataFrame:
    tok = t.part.select("p_partkey", "p_size", F.explode(F.split("p_name", " ")).alias("token"))
    kept = tok.join(tok.where("p_size > 40").select("token").distinct(), "token", "left_semi")
    return kept.groupBy("p_partkey").agg(F.array_join(F.array_sort(F.collect_list("token")), ",").alias("grounded"))


@query("""WITH l AS (SELECT o_custkey AS k, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)::BIGINT AS nth FROM orders),
  r AS (SELECT user_id AS k, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)::BIGINT AS nth FROM events)
  SELECT l.k, l.nth, l.o_orderkey, r.event_id FROM l LEFT JOIN r ON r.k = l.k AND r.nth = l.nth""")
def greedy_pairing(t: Tables) -> DataFrame:
    left = t.orders.select(F.col("o_custkey").alias("k"), "o_orderkey", "o_orderdate")
    right = t.events.select(F.col("user_id").alias("k"), "event_id", "ts")
    return M.pair_in_order(left, right, "k", ["o_orderdate", "o_orderkey"], ["ts", "event_id"]).select("k", "nth", "o_orderkey", "event_id")


@query(f"""WITH RECURSIVE o AS (SELECT *, {key('o_orderpriority')} AS company, {key('o_orderstatus')} AS title FROM orders),
  s AS MATERIALIZED (SELECT o_custkey AS g, o_orderkey AS pos, title, company, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k, count(*) OVER (PARTITION BY o_custkey) AS n FROM o),
  c AS MATERIALIZED (SELECT o_custkey AS g, 1000000000 - o_orderkey AS pos, title || CASE WHEN o_orderkey % 2 = 0 THEN 'lead' ELSE '' END AS title, company || CASE WHEN o_orderkey % 3 = 0 THEN 'group' ELSE '' END AS company FROM o WHERE o_orderkey % 5 <> 0),
  l AS MATERIALIZED (SELECT g, list({{'pos': pos, 'title': title, 'company': company}} ORDER BY pos) AS cs FROM c GROUP BY g),
  z AS (SELECT g, 0::BIGINT AS k, []::BIGINT[] AS used, NULL::BIGINT AS s, NULL::BIGINT AS c FROM (SELECT DISTINCT g FROM s) UNION ALL
    SELECT z.g, s.k, CASE WHEN len(hit) > 0 THEN z.used || [hit[1].pos] ELSE z.used END, s.pos, hit[1].pos FROM z JOIN s ON s.g = z.g AND s.k = z.k + 1 LEFT JOIN l ON l.g = z.g,
    LATERAL (SELECT CASE WHEN len(l.cs) >= greatest(1, floor(0.75 * s.n)) THEN list_filter(l.cs, lambda x: NOT list_contains(z.used, x.pos) AND (x.company = s.company OR (contains(x.title, s.title) AND contains(x.company, s.company)))) ELSE [] END AS hit))
  SELECT g AS k, s AS o_orderkey, 1000000000 - c AS rewritten FROM z WHERE k > 0""")
def merged_records(t: Tables) -> DataFrame:
    """Each customer's orders matched one to one with rewritten ones (a fifth is missing, companies and titles grow, the order is reversed)."""
    title, company = T.alnum_key(F.col("o_orderstatus")), T.alnum_key(F.col("o_orderpriority"))
    source = t.orders.select(F.col("o_custkey").alias("g"), F.col("o_orderkey").alias("pos"), title.alias("title"), company.alias("company"))
    longer = lambda c, k, word: F.concat(c, F.when(F.col("o_orderkey") % k == 0, F.lit(word)).otherwise(""))
    rewritten = t.orders.where("o_orderkey % 5 <> 0").select(F.col("o_custkey").alias("g"), (1_000_000_000 - F.col("o_orderkey")).alias("pos"), longer(title, 2, "lead").alias("title"), longer(company, 3, "group").alias("company"))
    got = assign.assign_first_free(source, rewritten)
    return got.select(F.col("g").alias("k"), F.col("s").alias("o_orderkey"), (1_000_000_000 - F.col("c")).alias("rewritten"))


@query("""WITH d AS (SELECT user_id, arg_max(event_type, (ts, event_id)) AS last_type FROM events GROUP BY user_id) SELECT c.c_custkey, d.last_type FROM customer c LEFT JOIN d ON d.user_id = c.c_custkey""")
def last_wins_lookup(t: Tables) -> DataFrame:
    e = t.events.select(F.col("user_id").alias("c_custkey"), F.col("event_type").alias("last_type"), F.struct("ts", "event_id").alias("p"))
    return t.customer.select("c_custkey").join(M.last_wins(e, "c_custkey", "p").drop("p"), "c_custkey", "left")


@query("""WITH n AS (SELECT p_name AS name, min(p_partkey) AS rank FROM part GROUP BY p_name)
  SELECT p.p_partkey, p.p_type || ' ' || p.p_name || ' kit' AS label, (SELECT n.name FROM n WHERE contains(' ' || lower(p.p_type || ' ' || p.p_name || ' kit') || ' ', ' ' || lower(n.name) || ' ') ORDER BY n.rank LIMIT 1) AS matched FROM part p""")
def first_contained(t: Tables) -> DataFrame:
    names = t.part.groupBy(F.col("p_name").alias("name")).agg(F.min("p_partkey").alias("rank"))
    rows = t.part.select("p_partkey", F.concat_ws(" ", "p_type", "p_name", F.lit("kit")).alias("label"))
    return M.first_contained(rows, names, "label", "p_partkey")


@query(r"""WITH s AS (SELECT DISTINCT p_name AS whole, p_type AS part, regexp_replace(lower(p_name || p_type), '[^a-z0-9]+', '', 'g') AS k FROM part WHERE p_size > 25),
  r AS (SELECT DISTINCT p_name || CASE WHEN p_size % 3 = 0 THEN ' plus' ELSE '' END AS whole, CASE WHEN p_size % 2 = 0 THEN p_type ELSE 'none of them' END AS part FROM part WHERE p_size <= 25),
  k AS (SELECT r.* FROM r WHERE EXISTS (SELECT 1 FROM s WHERE contains(s.k, regexp_replace(lower(r.whole), '[^a-z0-9]+', '', 'g')) OR contains(s.k, substring(regexp_replace(lower(r.part), '[^a-z0-9]+', '', 'g'), 1, 12))))
  SELECT whole, part FROM k UNION ALL SELECT whole, part FROM s WHERE NOT EXISTS (SELECT 1 FROM k)""")
def contained_rows(t: Tables) -> DataFrame:
    """Rewritten (name, type) rows that the source rows ground by containment of their keys."""
    source = t.part.where("p_size > 25").select(F.col("p_name").alias("whole"), F.col("p_type").alias("part")).distinct()
    plus = F.when(F.col("p_size") % 3 == 0, " plus").otherwise("")
    rows = t.part.where("p_size <= 25").select(F.concat("p_name", plus).alias("whole"), F.when(F.col("p_size") % 2 == 0, F.col("p_type")).otherwise("none of them").alias("part")).distinct()
    return M.contained_in_source(rows, source, "whole", "part")


@query("SELECT item_id FROM benchmark b WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE contains(d.text, b.text))")
def benchmark_missing(t: Tables) -> DataFrame:
    """Benchmark items that no document contains. An item meets documents by its second to fourth words, which stand
    whole in the text wherever the item does; whole texts confirm."""
    w, at_most = F.split("text", " "), F.lit(1 << 30)
    glue = lambda a, b: F.concat(a, F.lit(" "), b)
    grams = F.zip_with(F.zip_with(w, F.slice(w, F.lit(2), at_most), glue), F.slice(w, F.lit(3), at_most), glue)
    keyed = t.benchmark.select("item_id", F.col("text").alias("item"), F.array_join(F.slice(F.split("text", " "), 2, 3), " ").alias("g"))
    docs = t.documents.where(F.size(w) >= 3).select("doc_id", F.explode(F.array_distinct(F.array_compact(grams))).alias("g"))
    # grams meet without the texts, which only what has met is joined to again
    met = docs.join(keyed, "g").select("doc_id", "item_id", "item").distinct()
    hit = t.documents.select("doc_id", "text").join(met, "doc_id").where(F.contains("text", F.col("item"))).select("item_id").distinct()
    return t.benchmark.join(hit, "item_id", "left_anti").select("item_id")


_CT = "list_distinct(list_filter(regexp_extract_all(lower({0}), '[a-z0-9+]{{4,}}'), lambda w: w NOT IN ('with','that','this','from','have','were')))"


@query(f"""WITH a AS (SELECT doc_id AS claim, unnest({_CT.format("text")}) AS token, len({_CT.format("text")})::BIGINT AS n FROM documents), b AS (SELECT item_id AS fact, unnest({_CT.format("text")}) AS token FROM benchmark)
  SELECT claim, fact, count(*)::BIGINT AS hits, any_value(n) AS n FROM a JOIN b USING (token) GROUP BY claim, fact HAVING count(*) >= greatest(3, floor(0.45 * any_value(n)))""")
def benchmark_grounding(t: Tables) -> DataFrame:
    return M.grounded_pairs(t.documents.select(F.col("doc_id").alias("claim"), "text"), t.benchmark.select(F.col("item_id").alias("fact"), "text"))


@query(rf"""WITH {LINE}, k AS (SELECT doc_id, ln, line, substring(regexp_replace(lower(line), '[^a-z0-9]+', '', 'g'), 1, 60) AS k FROM line),
  s AS (SELECT DISTINCT substring(regexp_replace(lower(x), '[^a-z0-9]+', '', 'g'), 1, 60) AS k FROM (SELECT unnest(string_split(text, chr(10))) AS x FROM benchmark)) SELECT doc_id, ln, line FROM k WHERE k IN (SELECT k FROM s WHERE k <> '')""")
def prefix_trace(t: Tables) -> DataFrame:
    source = t.benchmark.select(F.explode(F.split("text", "\n")).alias("line"))
    return M.prefix_traced(L.lines(t.documents), source, "line")


_RULES = (("ECON|SMALL", "budget"), ("PROMO", "offer"), ("LARGE|MEDIUM", "regular"))


@query("""SELECT p_partkey, CASE WHEN regexp_matches(p_type, 'ECON|SMALL') THEN 'budget' WHEN regexp_matches(p_type, 'PROMO') THEN 'offer' WHEN regexp_matches(p_type, 'LARGE|MEDIUM') THEN 'regular' ELSE 'other' END AS category FROM part""")
def rule_categorize(t: Tables) -> DataFrame:
    return M.first_rule(t.part, F.col("p_type"), _RULES, "category", "other").select("p_partkey", "category")


@query("""WITH s AS (SELECT l_orderkey, count(*) AS a FROM lineitem GROUP BY 1), o AS (SELECT l_orderkey, count(*) AS b FROM lineitem WHERE l_discount <= 0.03 GROUP BY 1)
  SELECT l_orderkey, a::BIGINT AS n_source, b::BIGINT AS n_output FROM s JOIN o USING (l_orderkey) WHERE a >= 4 AND b < greatest(3, floor(0.6 * a))""")
def lost_detail(t: Tables) -> DataFrame:
    return M.lost_details(t.lineitem, t.lineitem.where("l_discount <= 0.03"), "l_orderkey")


@query(r"""WITH h AS (SELECT page_id, unnest(regexp_extract_all(html, '<(title|h1|p|table|article)>', 1)) AS section, generate_subscripts(regexp_extract_all(html, '<(title|h1|p|table|article)>', 1), 1) AS pos FROM pages),
  f AS (SELECT page_id, section, min(pos) AS pos FROM h GROUP BY ALL), e(section, rank, need) AS (VALUES ('title', 1, true), ('article', 2, true), ('h1', 3, true), ('p', 4, false), ('table', 5, false)),
  g AS (SELECT page_id, list(rank ORDER BY pos) AS r, list(section) AS have FROM f JOIN e USING (section) GROUP BY page_id)
  SELECT page_id, r = list_sort(r) AS ordered, coalesce(array_to_string(list_filter(['article', 'h1', 'title'], lambda x: NOT list_contains(have, x)), ','), '') AS missing FROM g""")
def section_order_check(t: Tables) -> DataFrame:
    tag = "<(title|h1|p|table|article)>"
    h = t.pages.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(tag), F.lit(1))).alias("pos", "section")).groupBy("page_id", "section").agg(F.min("pos").alias("pos"))
    expected = t.spark.createDataFrame([("title", 1, True), ("article", 2, True), ("h1", 3, True), ("p", 4, False), ("table", 5, False)], "section string, rank long, required boolean")
    return R.in_expected_order(h, expected, "page_id")


@query(f"WITH {LINE}, d AS (SELECT doc_id, string_agg(line, ' ' ORDER BY ln) FILTER (ln <= 3) AS head, string_agg(line, ' ' ORDER BY ln) AS body FROM line GROUP BY doc_id), k AS (SELECT doc_id, head, body, {_CT.format('body')} AS t FROM d) SELECT doc_id, length(head) >= greatest(80, 0.55 * length(body)) AND len(list_intersect(t, {_CT.format('head')})) >= greatest(3, floor(0.45 * len(t))) AS covered FROM k WHERE head IS NOT NULL")
def coverage_ratio(t: Tables) -> DataFrame:
    """Whether a document's first three lines keep the detail of its whole text."""
    rows = F.array_sort(F.collect_list(F.struct("ln", "line")))
    d = L.lines(t.documents).groupBy("doc_id").agg(rows.alias("r"))
    head = F.array_join(F.transform(F.filter("r", lambda x: x["ln"] <= 3), lambda x: x["line"]), " ")
    d = d.select("doc_id", head.alias("head"), F.array_join("r.line", " ").alias("body")).where("head <> ''")
    return d.select("doc_id", ranking.covered(F.col("body"), F.col("head")).alias("covered"))


# ---------------------------------------------------------------- sets


@query("""WITH u AS (SELECT c_nationkey AS k, 0 AS source_rank, min(c_custkey) AS pos FROM customer WHERE c_acctbal > 9000 GROUP BY 1 UNION ALL SELECT s_nationkey, 1, min(s_suppkey) FROM supplier GROUP BY 1)
  SELECT k, source_rank::BIGINT AS source_rank, pos FROM u QUALIFY row_number() OVER (PARTITION BY k ORDER BY source_rank, pos) = 1""")
def union_priority(t: Tables) -> DataFrame:
    a = t.customer.where("c_acctbal > 9000").select(F.col("c_nationkey").alias("k"), F.col("c_custkey").alias("pos"))
    return dedupe.union_priority(a, t.supplier.select(F.col("s_nationkey").alias("k"), F.col("s_suppkey").alias("pos")), key="k")


@query("""WITH s AS (SELECT p_brand, list_distinct(list(p_type)) AS t FROM part GROUP BY p_brand)
  SELECT a.p_brand AS a, b.p_brand AS b, len(list_intersect(a.t, b.t))::BIGINT AS common, len(list_distinct(list_concat(a.t, b.t)))::BIGINT AS total FROM s a JOIN s b ON a.p_brand < b.p_brand""")
def brand_jaccard(t: Tables) -> DataFrame:
    """All pairs of brands: a stated small dimension (25 brands), so the inequality join is bounded."""
    s = t.part.groupBy("p_brand").agg(F.collect_set("p_type").alias("t"))
    a, b = s.alias("a"), s.alias("b")
    return a.join(F.broadcast(b), F.col("a.p_brand") < F.col("b.p_brand")).select(
        F.col("a.p_brand").alias("a"), F.col("b.p_brand").alias("b"), _long(F.size(F.array_intersect("a.t", "b.t"))).alias("common"), _long(F.size(F.array_union("a.t", "b.t"))).alias("total"))


@query("SELECT n_nationkey, n_name FROM nation WHERE n_nationkey IN (SELECT n_nationkey FROM nation EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000)")
def missing_sections(t: Tables) -> DataFrame:
    have = t.supplier.where("s_acctbal > 5000").select(F.col("s_nationkey").alias("n_nationkey"))
    return t.nation.join(have, "n_nationkey", "left_anti").select("n_nationkey", "n_name")


@query("""SELECT 'order' || o_orderkey AS fact_id, 'order' AS section, o_orderkey AS parent, 0::BIGINT AS pos, o_orderstatus || ' | ' || o_orderpriority AS text FROM orders
  UNION ALL SELECT 'order' || l_orderkey || '.l' || l_linenumber || '.p' || l_partkey, 'line', l_orderkey, l_linenumber::BIGINT, l_returnflag || ' | ' || l_linestatus FROM lineitem""")
def fact_table(t: Tables) -> DataFrame:
    o = t.orders.select(F.concat(F.lit("order"), "o_orderkey").alias("fact_id"), F.lit("order").alias("section"), F.col("o_orderkey").alias("parent"), F.lit(0).cast("long").alias("pos"), F.concat_ws(" | ", "o_orderstatus", "o_orderpriority").alias("text"))
    li = t.lineitem.select(F.concat(F.lit("order"), "l_orderkey", F.lit(".l"), "l_linenumber", F.lit(".p"), "l_partkey").alias("fact_id"), F.lit("line").alias("section"), F.col("l_orderkey").alias("parent"), _long(F.col("l_linenumber")).alias("pos"), F.concat_ws(" | ", "l_returnflag", "l_linestatus").alias("text"))
    return o.unionByName(li)


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents),
  b AS (SELECT doc_id, i, unnest(string_split(line, '. ')) AS text, generate_subscripts(string_split(line, '. '), 1) - 1 AS j FROM l)
  SELECT doc_id, 'exp' || i || '.b' || j AS fact_id, 'exp' || i AS parent, j::BIGINT AS pos, text FROM b WHERE trim(text) <> ''
  UNION ALL SELECT doc_id, 'exp' || i || '.size.chars', 'exp' || i, NULL, length(line)::VARCHAR FROM l
  UNION ALL SELECT doc_id, 'meta.lang', '', NULL, lang FROM documents WHERE trim(lang) <> '' UNION ALL SELECT doc_id, 'meta.source', '', NULL, source FROM documents WHERE trim(source) <> ''""")
def nested_fact_table(t: Tables) -> DataFrame:
    """Documents as nested records (lines with their sentences and sizes, and what is known of the document), taken apart into facts."""
    line = lambda x: F.struct(F.split(x, r"\. ").alias("b"), F.struct(F.length(x).alias("chars")).alias("size"))
    store = F.to_variant_object(F.struct(F.transform(F.split("text", "\n"), line).alias("exp"), F.struct("lang", "source").alias("meta")))
    return facts.nested_facts(t.documents.select("doc_id", store.alias("store")), "doc_id", "store")


@query("""WITH s AS (SELECT p_partkey, string_split(p_name || ' ' || p_type || ' ' || p_name, ' ') AS w FROM part), e AS (SELECT p_partkey, unnest(w) AS x, generate_subscripts(w, 1) AS p FROM s), f AS (SELECT p_partkey, x, min(p) AS p FROM e GROUP BY ALL)
  SELECT p_partkey, string_agg(x, ' ' ORDER BY p) AS merged FROM f GROUP BY p_partkey""")
def ordered_distinct_concat(t: Tables) -> DataFrame:
    w = F.array_distinct(F.concat(F.split("p_name", " "), F.array("p_type"), F.split("p_name", " ")))
    return t.part.select("p_partkey", F.array_join(w, " ").alias("merged"))


# ---------------------------------------------------------------- rules


def document_rules() -> list[R.Rule]:
    c, n = F.col("text"), T.n_words(F.col("text"))
    marks = F.length(c) - F.length(F.regexp_replace(c, "[#$%&*<>|]", ""))
    return [
        R.Rule("short", "body", "critical", "fewer than 50 words", n < 50),
        R.Rule("symbols", "body", "critical", "symbols in over a fifth of the words", marks * 5 > n),
        R.Rule("long_line", "layout", "warn", "a line of 2000 characters or more", F.array_max(F.transform(F.split(c, "\n"), lambda x: F.length(x))) >= 2000),
        R.Rule("contact", "header", "warn", "an address is in the text", c.contains("@") & c.rlike(T.EMAIL)),
        R.Rule("license", "body", "warn", "a licence line is in the text", F.lower(c).contains("licensed under")),
    ]


_N = r"len(list_filter(string_split(regexp_replace(text, '\s+', ' ', 'g'), ' '), lambda w: w <> ''))"
_FIND = rf"""f AS (SELECT doc_id, 'short' AS rule_id, 'body' AS section, 'critical' AS severity, 'fewer than 50 words' AS issue FROM documents WHERE {_N} < 50
  UNION ALL SELECT doc_id, 'symbols', 'body', 'critical', 'symbols in over a fifth of the words' FROM documents WHERE (length(text) - length(regexp_replace(text, '[#$%&*<>|]', '', 'g'))) * 5 > {_N}
  UNION ALL SELECT doc_id, 'long_line', 'layout', 'warn', 'a line of 2000 characters or more' FROM documents WHERE list_max(list_transform(string_split(text, chr(10)), lambda x: length(x))) >= 2000
  UNION ALL SELECT doc_id, 'contact', 'header', 'warn', 'an address is in the text' FROM documents WHERE regexp_matches(text, '{T.EMAIL}')
  UNION ALL SELECT doc_id, 'license', 'body', 'warn', 'a licence line is in the text' FROM documents WHERE contains(lower(text), 'licensed under'))"""


@query(f"WITH {_FIND} SELECT * FROM f")
def quality_findings(t: Tables) -> DataFrame:
    return R.findings(t.documents, document_rules())


def document_validators() -> list[plugins.Validator]:
    """The same rules as plug-ins, over a document's lines."""
    marks, address = re.compile("[#$%&*<>|]"), re.compile(T.EMAIL)
    n_words = lambda lines: sum(len([w for w in re.split("[ \t\n\x0b\f\r]+", x) if w]) for x in lines)
    return [
        plugins.Validator("short", "body", "critical", "fewer than 50 words", lambda lines: n_words(lines) < 50),
        plugins.Validator("symbols", "body", "critical", "symbols in over a fifth of the words", lambda lines: 5 * sum(len(marks.findall(x)) for x in lines) > n_words(lines)),
        plugins.Validator("long_line", "layout", "warn", "a line of 2000 characters or more", lambda lines: max(map(len, lines)) >= 2000),
        plugins.Validator("contact", "header", "warn", "an address is in the text", lambda lines: any("@" in x and address.search(x) for x in lines)),
        plugins.Validator("license", "body", "warn", "a licence line is in the text", lambda lines: any("licensed under" in x.lower() for x in lines)),
    ]


@query(f"WITH {_FIND} SELECT * FROM f")
def plugin_findings(t: Tables) -> DataFrame:
    """The findings of quality_findings, said by validators that are called from SQL."""
    plugins.register(t.spark, "document_validators", document_validators())
    rows = t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("ln", "line"))
    return plugins.validate(rows, "document_validators", "doc_id", "ln", "line")


_EXPECTED = [("1-URGENT", 1, "Urgent", True), ("2-HIGH", 2, "High:", True), ("3-MEDIUM", 3, "Medium", False), ("5-LOW", 4, None, True)]


@query(r"""WITH x(section, rank, label, required) AS (VALUES ('1-URGENT', 1, 'Urgent', true), ('2-HIGH', 2, 'High:', true), ('3-MEDIUM', 3, 'Medium', false), ('5-LOW', 4, NULL, true)),
  s AS (SELECT o_custkey AS doc_id, min(o_orderkey) AS pos, o_orderpriority AS section, CASE WHEN min(o_orderkey) % 7 = 0 THEN 'Other title' ELSE upper(substring(o_orderpriority, 3)) || ':' END AS title FROM orders GROUP BY o_custkey, o_orderpriority),
  d AS (SELECT c_custkey AS doc_id, CASE WHEN c_custkey % 11 = 0 THEN 'Unknown' WHEN c_custkey % 13 = 0 THEN ' ' ELSE c_name END AS name, c_custkey % 5 = 0 AS contact, CASE WHEN c_custkey % 17 <> 0 THEN 'Arial' END AS family, (c_custkey % 20)::DOUBLE AS b, (c_custkey % 30)::DOUBLE AS h FROM customer),
  p AS (SELECT s.doc_id, string_agg(s.section, ',' ORDER BY s.pos) AS actual, string_agg(s.section, ',' ORDER BY x.rank) AS ordered FROM s JOIN x USING (section) WHERE s.doc_id IN (SELECT doc_id FROM d) GROUP BY s.doc_id)
  SELECT doc_id, 'structure' AS section, 'critical' AS severity, substring('Section order mismatch. expected=' || ordered || ' actual=' || actual, 1, 200) AS issue FROM p WHERE actual <> ordered
  UNION ALL SELECT d.doc_id, x.section, 'critical', 'Required section ''' || x.section || ''' is missing' FROM d, x WHERE x.required AND NOT EXISTS (SELECT 1 FROM s WHERE s.doc_id = d.doc_id AND s.section = x.section)
  UNION ALL SELECT s.doc_id, section, 'warn', 'Section label ''' || rtrim(title, ':') || ''' differs from format ''' || rtrim(label, ':') || '''' FROM s JOIN x USING (section) WHERE s.doc_id IN (SELECT doc_id FROM d) AND regexp_replace(lower(title), '[^a-z]', '', 'g') <> regexp_replace(lower(label), '[^a-z]', '', 'g')
  UNION ALL SELECT doc_id, 'styling', 'warn', 'font_size_body=' || b || ' outside sane range 8-16' FROM d WHERE b <> 0 AND (b < 8 OR b > 16)
  UNION ALL SELECT doc_id, 'styling', 'warn', 'font_size_header=' || h || ' outside sane range 8-24' FROM d WHERE h <> 0 AND (h < 8 OR h > 24)
  UNION ALL SELECT doc_id, 'styling', 'warn', 'font_family is missing' FROM d WHERE family IS NULL UNION ALL SELECT doc_id, 'header', 'critical', 'Name is missing' FROM d WHERE trim(name) IN ('', 'Unknown')
  UNION ALL SELECT doc_id, 'header', 'warn', 'Contact details are in the header' FROM d WHERE contact""")
def format_findings(t: Tables) -> DataFrame:
    """Customers as composed documents: their orders' priorities as sections, in order of the first order, against a format of four sections."""
    k = F.col("c_custkey")
    docs = t.customer.select(
        k.alias("doc_id"), F.when(k % 11 == 0, "Unknown").when(k % 13 == 0, " ").otherwise(F.col("c_name")).alias("name"), F.when(k % 5 == 0, F.array(F.lit(""), F.lit("a@b.org"))).alias("contacts"),
        F.when(k % 17 != 0, "Arial").alias("font_family"), (k % 20).cast("double").alias("font_size_body"), (k % 30).cast("double").alias("font_size_header"), F.lit(None).cast("double").alias("font_size_name"))
    first = t.orders.groupBy(F.col("o_custkey").alias("doc_id"), F.col("o_orderpriority").alias("section")).agg(F.min("o_orderkey").alias("pos"))
    title = F.when(F.col("pos") % 7 == 0, "Other title").otherwise(F.concat(F.upper(F.substring("section", 3, 100)), F.lit(":")))
    expected = t.spark.createDataFrame(_EXPECTED, "section string, rank long, label string, required boolean")
    return R.format_findings(docs, first.withColumn("title", title), expected)


@query(f"WITH {_FIND} SELECT rule_id, severity, count(*)::BIGINT AS n, count(DISTINCT doc_id)::BIGINT AS n_docs FROM f GROUP BY rule_id, severity")
def findings_rollup(t: Tables) -> DataFrame:
    return R.roll_up(R.findings(t.documents, document_rules()), "rule_id", "severity")


@query(f"""WITH {_FIND}, s AS (SELECT d.doc_id, count(*) FILTER (f.severity = 'critical')::BIGINT AS n_critical, count(*) FILTER (f.severity = 'warn')::BIGINT AS n_warn FROM documents d LEFT JOIN f USING (doc_id) GROUP BY d.doc_id)
  SELECT s.*, greatest(0, 100 - 12 * n_critical - 2 * n_warn)::BIGINT AS score, l.quality::BIGINT AS quality FROM s LEFT JOIN labels l USING (doc_id)""")
def quality_score(t: Tables) -> DataFrame:
    got = R.quality_score(R.findings(t.documents, document_rules()), t.documents)
    return got.join(t.labels.select("doc_id", _long(F.col("quality")).alias("quality")), "doc_id", "left")


def _judged(source: str, k: int) -> str:
    n = r"len(list_filter(string_split(regexp_replace(text, '\s+', ' ', 'g'), ' '), lambda w: w <> ''))"
    yes = lambda c: f"coalesce(({c})::INT, 0)"
    critical = f"{yes(f'{n} < 50')} + " + yes(f"(length(text) - length(regexp_replace(text, '[#$%&*<>|]', '', 'g'))) * 5 > {n}")
    warn = " + ".join(yes(c) for c in ("list_max(list_transform(string_split(text, chr(10)), lambda x: length(x))) >= 2000", f"regexp_matches(text, '{T.EMAIL}')", "contains(lower(text), 'licensed under')"))
    return f"j{k} AS (SELECT doc_id, text, critical, greatest(0, 100 - 12 * critical - 2 * warn)::BIGINT AS score, {k}::BIGINT AS round FROM (SELECT doc_id, text, {critical} AS critical, {warn} AS warn FROM {source}))"


def _fixed(k: int) -> str:
    c = r"regexp_replace(text, '(?i)(^|\n)[^\n]*licensed under[^\n]*', '', 'g')"
    return f"f{k} AS (SELECT doc_id, regexp_replace(regexp_replace({c}, '{T.EMAIL}', '[EMAIL]', 'g'), '[#$%&*<>|]+', '', 'g') AS text FROM j{k - 1} WHERE score < 85 OR critical > 0)"


@query(f"""WITH {_judged('documents', 0)}, {_fixed(1)}, {_judged('f1', 1)}, {_fixed(2)}, {_judged('f2', 2)}, a AS (SELECT * FROM j0 UNION ALL SELECT * FROM j1 UNION ALL SELECT * FROM j2)
  SELECT doc_id, score, round FROM a QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, round) = 1""")
def repair_rounds(t: Tables) -> DataFrame:
    """Two rounds: licence lines and symbol-laden words go, addresses are masked; the best draft of each document stays."""
    def fix(df: DataFrame) -> DataFrame:
        c = F.regexp_replace("text", "(?i)(^|\n)[^\n]*licensed under[^\n]*", "")
        c = F.regexp_replace(F.regexp_replace(c, T.EMAIL, "[EMAIL]"), "[#$%&*<>|]+", "")
        return df.select("doc_id", c.alias("text"))

    return R.repair(t.documents, document_rules(), fix, written=written).select("doc_id", "score", "round")


@query(rf"""WITH h AS (SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, len(regexp_extract_all(html, '<p>'))::BIGINT AS n_p FROM pages)
  SELECT page_id, 'title' AS section, 'critical' AS severity FROM h WHERE length({squash("title")}) < 10 UNION ALL SELECT page_id, 'paragraphs', 'warn' FROM h WHERE n_p < 3""")
def header_audit(t: Tables) -> DataFrame:
    h = t.pages.select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.size(F.regexp_extract_all("html", F.lit("(<p>)"), F.lit(1))).alias("n_p"))
    audit = [R.Rule("title", "title", "critical", "short title", F.length(T.squash(F.col("title"))) < 10), R.Rule("p", "paragraphs", "warn", "few paragraphs", F.col("n_p") < 3)]
    return R.findings(h, audit, "page_id").select("page_id", "section", "severity")


@query(f"""WITH {LINE}, s AS (SELECT doc_id, ln, line, {score('line')} AS score FROM line WHERE length(line) >= 25), u AS (SELECT *, regexp_replace(lower(line), '[^a-z0-9]+', '', 'g') AS k FROM s),
  d AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY doc_id, k ORDER BY ln) = 1), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, ln) AS rk FROM d),
  b AS (SELECT *, sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY ln ROWS UNBOUNDED PRECEDING) AS used FROM r WHERE rk <= 8)
  SELECT doc_id, count(*)::BIGINT AS n_lines, string_agg(line, chr(10) ORDER BY ln) AS text FROM b WHERE used <= 3000 GROUP BY doc_id""")
def condensed_documents(t: Tables) -> DataFrame:
    """End to end: lines, distinct, score, the eight best within a budget of characters, assembled in order."""
    rows = L.lines(t.documents).where("length(line) >= 25")
    rows = _distinct(rows)
    best = ranking.top_k(rows.withColumn("score", ranking.line_score(F.col("line"))), ["doc_id"], 8, [F.desc("score"), F.col("ln")])
    fit = L.within_budget(best, 3000, at_least=0)
    return L.gather(fit, sep="\n").select("doc_id", "n_lines", "text")


def _distinct(rows: DataFrame) -> DataFrame:
    """First of equal keys; lines without a key count as equal too."""
    return dedupe.keep_first(rows, F.concat(F.lit("k"), T.alnum_key(F.col("line"))), ["ln"], ["doc_id"])


# ---------------------------------------------------------------- beyond the reference: labelled extensions


@query("""SELECT coalesce(l_returnflag, '*') AS flag, coalesce(l_linestatus, '*') AS status, count(*)::BIGINT AS n, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)""")
def ext_revenue_cube(t: Tables) -> DataFrame:
    star = lambda c, n: F.coalesce(F.col(c), F.lit("*")).alias(n)
    cube = t.lineitem.cube("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))
    return cube.select(star("l_returnflag", "flag"), star("l_linestatus", "status"), "n", "revenue")


@query("""WITH g AS (SELECT user_id, ts, event_id, sum((b IS NULL OR ts - b > INTERVAL 30 MINUTE)::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS session FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events))
  SELECT user_id, session, count(*)::BIGINT AS n FROM g GROUP BY user_id, session""")
def ext_event_sessions(t: Tables) -> DataFrame:
    return sessionize(t.events).groupBy("user_id", "session").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT time_bucket(INTERVAL 5 MINUTE, ts) AS window_start, event_type, count(*)::BIGINT AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL")
def ext_event_windows(t: Tables) -> DataFrame:
    got = windowed(t.events, "5 minutes")
    return got.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", F.round("total", 6).alias("total"))
