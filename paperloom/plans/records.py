"""Lines, sections, records, distinct and aggregate queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import text as T
from ..operators import dedupe, degrees, greedy, lines as L, ranking, roles
from ..sources.tables import Tables
from .registry import LINE, heading, key, query, score, squash, words


def _long(c: F.Column) -> F.Column:
    return c.cast("long")


# ---------------------------------------------------------------- sections and records

_SECT = f"""{LINE}, h AS (SELECT *, {heading('line')} AS is_h FROM line),
s AS (SELECT doc_id, ln, line, coalesce(last_value(CASE WHEN is_h THEN line END IGNORE NULLS) OVER w, 'start') AS section, sum(is_h::INT) OVER w::BIGINT AS block
  FROM h WINDOW w AS (PARTITION BY doc_id ORDER BY ln ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""


@query(f"WITH {_SECT} SELECT doc_id, ln, section, block FROM s")
def sectionize_lines(t: Tables) -> DataFrame:
    return L.sections(L.lines(t.documents), T.is_heading(F.col("line"))).select("doc_id", "ln", "section", "block")


@query(f"WITH {_SECT} SELECT doc_id, ln, line, section FROM s WHERE section <> 'start' AND block = (SELECT min(x.block) FROM s x WHERE x.doc_id = s.doc_id AND x.section <> 'start')")
def first_section_lines(t: Tables) -> DataFrame:
    got = L.sections(L.lines(t.documents), T.is_heading(F.col("line")))
    return L.section_lines(got, F.col("section") != "start", all_blocks=False).select("doc_id", "ln", "line", "section")


@query(rf"""WITH {LINE}, p AS (SELECT doc_id, ln, line, lag(line) OVER (PARTITION BY doc_id ORDER BY ln) AS b FROM line),
  c AS (SELECT doc_id, ln, line, b IS NOT NULL AND (regexp_matches(lower(line), '^(and|or|with|using|for|to|of) ') OR (regexp_matches(line, '^[a-z]') AND NOT regexp_matches(b, '[.;:!?]\s*$'))
    OR (NOT regexp_matches(b, '[.;:!?]\s*$') AND length(b) >= 60 AND len({words('line')}) <= 12 AND regexp_matches(line, '^[a-z]'))) AS cont FROM p),
  i AS (SELECT *, sum((NOT cont)::INT) OVER (PARTITION BY doc_id ORDER BY ln ROWS UNBOUNDED PRECEDING)::BIGINT AS item FROM c)
  SELECT doc_id, item, min(ln)::BIGINT AS ln, count(*)::BIGINT AS n_lines, string_agg(line, ' ' ORDER BY ln) AS text FROM i GROUP BY doc_id, item""")
def merge_wrapped_lines(t: Tables) -> DataFrame:
    return L.merge_wrapped(L.lines(t.documents))


@query(rf"""WITH {LINE}, n AS (SELECT doc_id, ln, line, lead(line) OVER (PARTITION BY doc_id ORDER BY ln) AS nx, sum(regexp_matches(line, '[0-9]{{4}}')::INT) OVER (PARTITION BY doc_id ORDER BY ln ROWS UNBOUNDED PRECEDING)::BIGINT AS rec FROM line)
  SELECT doc_id, rec, min(ln)::BIGINT AS ln, coalesce(nullif(CASE WHEN trim(arg_min(trim(regexp_replace(line, '[0-9]{{4}}', '', 'g')), ln)) <> '' THEN arg_min(trim(regexp_replace(line, '[0-9]{{4}}', '', 'g')), ln) END, ''), arg_min(nx, ln)) AS title,
  regexp_extract(arg_min(line, ln), '[0-9]{{4}}') AS year, count(*)::BIGINT AS n_lines FROM n WHERE rec > 0 GROUP BY doc_id, rec""")
def dated_records(t: Tables) -> DataFrame:
    return L.dated_records(L.lines(t.documents), "[0-9]{4}")


@query("""WITH i AS (SELECT l_orderkey, string_agg('Shipped part ' || l_partkey || ' from shelf ' || l_linenumber || '.', ' / ' ORDER BY l_linenumber, l_partkey, l_suppkey) AS items FROM lineitem GROUP BY l_orderkey)
  SELECT o_custkey AS doc_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rec, 'Lead ' || o_orderkey || CASE WHEN o_orderkey % 4 = 0 THEN ' | Desk ' || substring(o_orderpriority, 1, 1) ELSE '' END AS title,
    'Firm ' || o_orderkey AS company, CASE o_orderkey % 4 WHEN 0 THEN 'Irving, TX' WHEN 2 THEN 'Pune' ELSE '' END AS location, strftime(o_orderdate, '%b %Y') || ' - ' || strftime(o_orderdate + INTERVAL 5 MONTH, '%b %Y') AS duration,
    'Java, Tool ' || o_orderkey % 7 AS technologies, i.items FROM orders JOIN i ON l_orderkey = o_orderkey""")
def role_records(t: Tables) -> DataFrame:
    """Customers' orders written as dated roles in four layouts, with places and titles on lines of their own, wrapped items and other
    sections, and read back by the record builder."""
    k = F.col("o_orderkey").cast("string")
    month = lambda d: F.date_format(d, "MMM yyyy")
    dates = F.concat(month(F.col("o_orderdate")), F.lit(" - "), month(F.add_months("o_orderdate", 5)))
    lead, firm, say = F.concat(F.lit("Lead "), k), F.concat(F.lit("Firm "), k), lambda *c: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in c])
    head = (
        F.when(F.col("o_orderkey") % 4 == 0, F.array(say(firm, " ", dates), F.lit("Irving, TX"), say(lead, " | Desk ", F.substring("o_orderpriority", 1, 1))))
        .when(F.col("o_orderkey") % 4 == 1, F.array(say(lead, " | ", firm, " ", dates)))
        .when(F.col("o_orderkey") % 4 == 2, F.array(lead, say(firm, ", Pune ", dates)))
        .otherwise(F.array(say(lead, " at ", firm, " ", dates)))
    )
    tools = F.array(say("Environment: Java, Tool ", (F.col("o_orderkey") % 7).cast("string")))
    shelf = lambda x: say("from shelf ", x["l_linenumber"].cast("string"), ".")
    part = lambda x: say("\u2022 Shipped part ", x["l_partkey"].cast("string"))
    item = lambda x: F.when(x["l_linenumber"] % 2 == 0, F.array(part(x), shelf(x))).otherwise(F.array(say(part(x), " ", shelf(x))))
    shipped = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey"))).alias("r"))
    written = t.orders.join(shipped, "o_orderkey").select("o_custkey", "o_orderdate", "o_orderkey", F.concat(head, tools, F.flatten(F.transform("r", item))).alias("block"))
    blocks = written.groupBy(F.col("o_custkey").alias("doc_id")).agg(F.array_sort(F.collect_list(F.struct("o_orderdate", "o_orderkey", "block"))).alias("r"))
    around = lambda *x: F.array(*[F.lit(v) for v in x])
    text = F.concat(around("A Customer", "PROFESSIONAL EXPERIENCE", ""), F.flatten("r.block"), around("", "EDUCATION", "Diploma 2001 - 2003", "School of Trade"))
    got = roles.section_roles(blocks.select("doc_id", text.alias("lines")), "experience")
    return got.select("doc_id", "rec", "title", "company", "location", "duration", F.array_join("technologies", ", ").alias("technologies"), F.array_join("items", " / ").alias("items"))


@query("""WITH k AS (SELECT p_brand, p_partkey, p_type, p_size, floor(p_retailprice)::BIGINT AS price FROM part)
  SELECT replace(p_brand, 'Brand#', '')::BIGINT AS doc_id, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS rec, 'Part' || p_partkey || ' – ' || p_type AS name, 'Java, Size ' || p_size AS technologies,
  'Costs ' || price || ' in all and no more.' || CASE WHEN p_partkey % 2 = 0 THEN ' / Weighs nothing.' ELSE '' END AS items FROM k""")
def project_records(t: Tables) -> DataFrame:
    """Brands' parts written as projects, closed by blank lines or by the next title, and read back by the record builder."""
    say = lambda *c: F.concat(*[F.lit(x) if isinstance(x, str) else x.cast("string") for x in c])
    even = F.col("p_partkey") % 2 == 0
    lines = F.concat(
        F.array(say("Part", F.col("p_partkey"), " – ", F.col("p_type"), " (Java, Size ", F.col("p_size"), ")"), say("- Costs ", F.floor("p_retailprice"), " in all"), F.lit("and no more.")),
        F.when(even, F.array(F.lit("* Weighs nothing."), F.lit(""))).otherwise(F.array().cast("array<string>")))
    brand = _long(F.regexp_replace("p_brand", "Brand#", ""))
    docs = t.part.groupBy(brand.alias("doc_id")).agg(F.array_sort(F.collect_list(F.struct("p_partkey", lines.alias("lines")))).alias("r"))
    text = F.concat(F.array(F.lit("A Brand"), F.lit("KEY PROJECTS")), F.flatten("r.lines"), F.array(F.lit("LANGUAGES"), F.lit("Latin – Old")))
    got = degrees.projects(docs.select("doc_id", F.posexplode(text).alias("ln", "line")))
    return got.select("doc_id", "rec", "name", F.array_join("technologies", ", ").alias("technologies"), F.array_join("items", " / ").alias("items"))


@query("""SELECT s_nationkey::BIGINT AS doc_id, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS rec, 'Diploma No ' || s_suppkey AS degree, 'College of Trade ' || s_suppkey AS institution,
  CASE s_suppkey % 2 WHEN 0 THEN '20' || lpad((s_suppkey % 20)::VARCHAR, 2, '0') || ' - 20' || lpad((s_suppkey % 20 + 3)::VARCHAR, 2, '0') ELSE '19' || lpad((s_suppkey % 90)::VARCHAR, 2, '0') END AS year,
  CASE s_suppkey % 2 WHEN 0 THEN (s_suppkey % 10) || '.5/10' ELSE '' END AS grade, 'Sold ' || s_name AS details FROM supplier""")
def education_records(t: Tables) -> DataFrame:
    """Nations' suppliers written as degrees in two layouts and read back by the record builder."""
    say = lambda *c: F.concat(*[F.lit(x) if isinstance(x, str) else x.cast("string") for x in c])
    k = F.col("s_suppkey")
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    school, sold = say("Collegeof Trade ", k), say("• Sold ", F.col("s_name"))
    lines = F.when(k % 2 == 0, F.array(say("Diploma No ", k, "|CGPA:", k % 10, ".5/10 20", two(k % 20), " - 20", two(k % 20 + 3)), school, sold)).otherwise(
        F.array(say("Diploma No ", k), school, say("in 19", two(k % 90)), sold))
    docs = t.supplier.groupBy(_long(F.col("s_nationkey")).alias("doc_id")).agg(F.array_sort(F.collect_list(F.struct("s_suppkey", lines.alias("lines")))).alias("r"))
    text = F.concat(F.array(F.lit("A Nation"), F.lit("EDUCATION")), F.flatten("r.lines"), F.array(F.lit("AWARDS"), F.lit("Best of 2001")))
    got = degrees.education(docs.select("doc_id", F.posexplode(text).alias("ln", "line")))
    return got.select("doc_id", "rec", "degree", "institution", "year", "grade", F.array_join("details", " / ").alias("details"))


@query(rf"""WITH {LINE}, n AS (SELECT *, sum(contains(line, '|')::INT) OVER (PARTITION BY doc_id ORDER BY ln ROWS UNBOUNDED PRECEDING)::BIGINT AS rec FROM line)
  SELECT doc_id, rec, min(ln)::BIGINT AS ln, count(*)::BIGINT AS n_lines, string_agg(line, ' ' ORDER BY ln) AS text FROM n WHERE rec > 0 GROUP BY doc_id, rec""")
def keyword_islands(t: Tables) -> DataFrame:
    return L.gather(L.islands(L.lines(t.documents), F.col("line").contains("|")).where("rec > 0"), "rec")


@query(rf"""WITH {LINE}, n AS (SELECT *, regexp_matches(line, '[.!?]$') AS ends FROM line),
  m AS (SELECT *, coalesce(sum(ends::INT) OVER (PARTITION BY doc_id ORDER BY ln ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS rec FROM n)
  SELECT doc_id, rec, count(*)::BIGINT AS n_lines, sum(length(line))::BIGINT AS n_chars FROM m GROUP BY doc_id, rec""")
def closed_records(t: Tables) -> DataFrame:
    """Records that a closing line ends: the number grows behind it."""
    before = W.partitionBy("doc_id").orderBy("ln").rowsBetween(W.unboundedPreceding, -1)
    rows = L.lines(t.documents).withColumn("ends", F.col("line").rlike("[.!?]$").cast("long"))
    rows = rows.withColumn("rec", F.coalesce(F.sum("ends").over(before), F.lit(0)))
    return rows.groupBy("doc_id", "rec").agg(F.count(F.lit(1)).alias("n_lines"), _long(F.sum(F.length("line"))).alias("n_chars"))


@query("SELECT event_id, user_id, event_type, lead(event_type) OVER w AS next_type, lead(event_type) OVER w = 'purchase' AS leads_to_purchase FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def next_event(t: Tables) -> DataFrame:
    nxt = F.lead("event_type").over(W.partitionBy("user_id").orderBy("ts", "event_id"))
    return t.events.select("event_id", "user_id", "event_type", nxt.alias("next_type"), (nxt == "purchase").alias("leads_to_purchase"))


@query("SELECT event_id, user_id, event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events) WHERE b IS NULL OR b <> event_type")
def adjacent_distinct(t: Tables) -> DataFrame:
    b = F.lag("event_type").over(W.partitionBy("user_id").orderBy("ts", "event_id"))
    return t.events.withColumn("b", b).where("b is null or b <> event_type").select("event_id", "user_id", "event_type")


@query(f"""WITH {LINE}, r AS (SELECT doc_id, ln, row_number() OVER (PARTITION BY doc_id ORDER BY ln)::BIGINT AS from_top, row_number() OVER (PARTITION BY doc_id ORDER BY ln DESC)::BIGINT AS from_end FROM line)
  SELECT * FROM r WHERE from_top <= 8 OR from_end <= 8""")
def edge_lines(t: Tables) -> DataFrame:
    return L.numbered(L.lines(t.documents), 8).select("doc_id", "ln", "from_top", "from_end")


@query(f"""WITH {LINE}, r AS (SELECT doc_id, ln, sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY ln ROWS UNBOUNDED PRECEDING)::BIGINT AS used, row_number() OVER (PARTITION BY doc_id ORDER BY ln) AS n FROM line)
  SELECT doc_id, ln, used FROM r WHERE used <= 1600 OR n <= 1""")
def char_budget_prefix(t: Tables) -> DataFrame:
    return L.within_budget(L.lines(t.documents), 1600).select("doc_id", "ln", "used")


@query(f"""WITH RECURSIVE {LINE}, l AS MATERIALIZED (SELECT doc_id, ln, length(line)::BIGINT AS n, row_number() OVER (PARTITION BY doc_id ORDER BY ln) AS k FROM line),
  f AS (SELECT doc_id, ln, k, 0::BIGINT AS chunk, n AS size FROM l WHERE k = 1
    UNION ALL SELECT l.doc_id, l.ln, l.k, f.chunk + CASE WHEN f.size > 0 AND f.size + l.n > 1500 THEN 1 ELSE 0 END, CASE WHEN f.size > 0 AND f.size + l.n > 1500 THEN l.n ELSE f.size + l.n END
    FROM f JOIN l ON l.doc_id = f.doc_id AND l.k = f.k + 1)
  SELECT doc_id, ln, chunk FROM f""")
def chunk_pack(t: Tables) -> DataFrame:
    return L.chunks(L.lines(t.documents), 1500)


# ---------------------------------------------------------------- distinct and keep-richest


@query(f"WITH {LINE} SELECT doc_id, ln, line FROM line WHERE trim(lower(line)) <> '' QUALIFY row_number() OVER (PARTITION BY doc_id, lower(line) ORDER BY ln) = 1")
def line_dedupe_folded(t: Tables) -> DataFrame:
    return dedupe.keep_first(L.lines(t.documents).where("trim(lower(line)) <> ''"), F.lower("line"), ["ln"], ["doc_id"])


@query(f"WITH {LINE}, k AS (SELECT doc_id, ln, line, {key('line')} AS k FROM line) SELECT doc_id, ln, line FROM k WHERE length(k) >= 12 QUALIFY row_number() OVER (PARTITION BY doc_id, k ORDER BY ln) = 1")
def line_dedupe_first(t: Tables) -> DataFrame:
    k = T.alnum_key(F.col("line"))
    return dedupe.keep_first(L.lines(t.documents).where(F.length(k) >= 12), k, ["ln"], ["doc_id"])


@query(f"""WITH k AS (SELECT doc_id, n_chars, {key('text')} AS text_key FROM documents WHERE {key('text')} <> '')
  SELECT md5(text_key) AS k, min(doc_id) AS first_id, arg_max(doc_id, (n_chars, -doc_id)) AS kept_id, max(n_chars) AS n_chars FROM k GROUP BY text_key""")
def exact_dedupe_keep_longest(t: Tables) -> DataFrame:
    keyed = t.documents.where(T.alnum_key(F.col("text")) != "").select(F.md5(T.alnum_key(F.col("text"))).alias("k"), F.col("doc_id").alias("kept_id"), "n_chars", F.col("doc_id").alias("first_id"))
    return dedupe.keep_richest(keyed, "k", F.col("n_chars"), "first_id")


@query("""WITH r AS (SELECT s_nationkey, s_suppkey, s_name, length(s_name) + CASE WHEN s_acctbal > 5000 THEN 8 ELSE 0 END + CASE WHEN s_suppkey % 2 = 0 THEN 10 ELSE 0 END AS score FROM supplier)
  SELECT s_nationkey, s_suppkey, s_name, score::BIGINT AS score FROM r QUALIFY row_number() OVER (PARTITION BY s_nationkey ORDER BY score DESC, s_suppkey) = 1""")
def best_row_per_group(t: Tables) -> DataFrame:
    s = _long(F.length("s_name") + F.when(F.col("s_acctbal") > 5000, 8).otherwise(0) + F.when(F.col("s_suppkey") % 2 == 0, 10).otherwise(0))
    best = t.supplier.groupBy("s_nationkey").agg(F.max_by(F.struct("s_suppkey", "s_name", s.alias("score")), F.struct(s.alias("a"), (-F.col("s_suppkey")).alias("b"))).alias("r"))
    return best.select("s_nationkey", "r.*")


@query("""SELECT o_custkey, arg_max(o_orderkey, (o_orderstatus = 'F', o_totalprice, -o_orderkey)) AS o_orderkey, count(*)::BIGINT AS n FROM orders GROUP BY o_custkey""")
def argmax_lexi(t: Tables) -> DataFrame:
    order = F.struct((F.col("o_orderstatus") == "F").alias("a"), F.col("o_totalprice").alias("b"), (-F.col("o_orderkey")).alias("c"))
    return t.orders.groupBy("o_custkey").agg(F.max_by("o_orderkey", order).alias("o_orderkey"), F.count(F.lit(1)).alias("n"))


@query("""SELECT s_nationkey, CASE WHEN s_acctbal > 3000 THEN 'header' ELSE 'footer' END AS class, s_suppkey FROM supplier
  QUALIFY row_number() OVER (PARTITION BY s_nationkey, CASE WHEN s_acctbal > 3000 THEN 'header' ELSE 'footer' END ORDER BY s_acctbal DESC, length(s_name) DESC, s_suppkey) = 1""")
def pick_per_class(t: Tables) -> DataFrame:
    c = t.supplier.withColumn("class", F.when(F.col("s_acctbal") > 3000, "header").otherwise("footer"))
    return ranking.top_k(c, ["s_nationkey", "class"], 1, [F.desc("s_acctbal"), F.length("s_name").desc(), F.col("s_suppkey")]).select("s_nationkey", "class", "s_suppkey")


# ---------------------------------------------------------------- aggregates


@query(f"""WITH {LINE} SELECT doc_id, count(*)::BIGINT AS n_lines, sum(length(line))::BIGINT AS n_chars, sum(len({words('line')}))::BIGINT AS n_words, max(length(line))::BIGINT AS longest FROM line GROUP BY doc_id""")
def document_stats(t: Tables) -> DataFrame:
    n = F.length("line")
    return L.lines(t.documents).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_lines"), _long(F.sum(n)).alias("n_chars"), _long(F.sum(T.n_words(F.col("line")))).alias("n_words"), _long(F.max(n)).alias("longest"))


@query(f"""WITH {LINE}, p AS (SELECT doc_id, (sum(least(greatest(length(line), 60), 320)) + 450)::BIGINT AS chars FROM line GROUP BY doc_id)
  SELECT doc_id, chars, greatest(0.5::DOUBLE, chars / 3000) AS pages, CASE WHEN greatest(0.5::DOUBLE, chars / 3000) <= 5.2 THEN 5.0 ELSE round_even(least(6.0::DOUBLE, greatest(5.0::DOUBLE, 0.58::DOUBLE * greatest(0.5::DOUBLE, chars / 3000))), 2) END::DOUBLE AS target FROM p""")
def page_estimate(t: Tables) -> DataFrame:
    return ranking.pages(L.lines(t.documents))


@query(f"""WITH {LINE}, k AS (SELECT doc_id, source, ln, line, {key('line')} AS k, row_number() OVER (PARTITION BY doc_id ORDER BY ln) AS a, row_number() OVER (PARTITION BY doc_id ORDER BY ln DESC) AS b FROM line),
  n AS (SELECT source, count(DISTINCT doc_id) AS docs FROM line GROUP BY source), c AS (SELECT source, k, count(*) AS n FROM k WHERE (a <= 3 OR b <= 3) AND k <> '' GROUP BY source, k)
  SELECT k.source, k.doc_id, k.ln, k.line FROM k JOIN c ON c.source = k.source AND c.k = k.k JOIN n ON n.source = k.source WHERE c.n >= greatest(2, floor(0.04 * n.docs))""")
def repeated_lines_by_source(t: Tables) -> DataFrame:
    return repeated_edge_lines(L.lines(t.documents, "source"), "source", 0.04)


def repeated_edge_lines(rows: DataFrame, group: str, share: float, n: int = 3, least: int = 2) -> DataFrame:
    """Lines, anywhere, whose normalized text stands among the first or last n of at least max(least, int(share × documents)) documents of a group."""
    k = rows.withColumn("k", T.alnum_key(F.col("line")))
    docs = rows.groupBy(group).agg(F.countDistinct("doc_id").alias("docs"))
    often = L.numbered(k, n).where("k <> ''").groupBy(group, "k").agg(F.count(F.lit(1)).alias("n")).join(docs, group).where(F.col("n") >= F.greatest(F.lit(least), F.floor(T.part_of(share, F.col("docs")))))
    return k.join(often.select(group, "k"), [group, "k"], "left_semi").select(group, "doc_id", "ln", "line")


@query("""WITH c AS (SELECT user_id, event_type, count(*) AS n, min(ts) AS f FROM events GROUP BY ALL)
  SELECT a.user_id, c.event_type AS main_type, a.mean_value FROM (SELECT user_id, round(avg(value), 1) AS mean_value FROM events GROUP BY user_id) a JOIN c ON c.user_id = a.user_id QUALIFY row_number() OVER (PARTITION BY a.user_id ORDER BY c.n DESC, c.f) = 1""")
def style_profile(t: Tables) -> DataFrame:
    per = t.events.groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("f"), F.sum("value").alias("s"))
    mode = F.max_by("event_type", F.struct("n", (-F.unix_micros(F.col("f").cast("timestamp"))).alias("f")))
    # a sum of doubles depends on the order of the rows, which decides means that lie halfway; a decimal sum does not
    # (of values that ten decimals write in full)
    decimal = F.col("value").try_cast("decimal(28,10)")
    exact = F.sum(decimal)
    same = F.count(F.when(decimal.cast("double") == F.col("value"), 1)) == F.count("value")
    mean = t.events.groupBy("user_id").agg(F.round(F.when(same, exact.cast("double") / F.count("value")).otherwise(F.avg("value")), 1).alias("mean_value"))
    return per.groupBy("user_id").agg(mode.alias("main_type")).join(mean, "user_id")


@query("""SELECT p_type, p_brand, string_agg(DISTINCT p_name, ',' ORDER BY p_name) AS names, count(*)::BIGINT AS n FROM part GROUP BY p_type, p_brand""")
def group_to_map(t: Tables) -> DataFrame:
    return t.part.groupBy("p_type", "p_brand").agg(F.array_join(F.array_sort(F.collect_set("p_name")), ",").alias("names"), F.count(F.lit(1)).alias("n"))


@query(f"WITH {LINE} SELECT doc_id, count(*)::BIGINT AS n_lines, avg((length(line) < 35)::INT)::DOUBLE AS short_share, avg((length(line) < 35)::INT) > 0.55 AND count(*) > 20 AS two_column FROM line GROUP BY doc_id")
def layout_ratio(t: Tables) -> DataFrame:
    share, n = F.avg((F.length("line") < 35).cast("int")), F.count(F.lit(1))
    return L.lines(t.documents).groupBy("doc_id").agg(n.alias("n_lines"), share.alias("short_share"), ((share > 0.55) & (n > 20)).alias("two_column"))


@query(f"""WITH {LINE}, t AS (SELECT DISTINCT doc_id, ln, unnest(list_filter({words('lower(line)')}, lambda w: length(w) >= 8)) AS token FROM line)
  SELECT doc_id, min(ln)::BIGINT AS ln, token FROM t GROUP BY doc_id, token HAVING count(*) = 1""")
def token_unique_owner(t: Tables) -> DataFrame:
    tok = L.lines(t.documents).select("doc_id", "ln", F.explode(F.array_distinct(F.filter(T.words(F.lower("line")), lambda w: F.length(w) >= 8))).alias("token"))
    return tok.groupBy("doc_id", "token").agg(F.min("ln").alias("ln"), F.count(F.lit(1)).alias("n")).where("n = 1").drop("n")


@query("SELECT conv_id, sum(greatest(1, length(text) // 4))::BIGINT AS tokens, round(sum(greatest(1, length(text) // 4)) * CASE WHEN max(role) LIKE '%user%' THEN 0.27 ELSE 0.5 END / 1000000, 9)::DOUBLE AS cost FROM conversations GROUP BY conv_id")
def token_cost(t: Tables) -> DataFrame:
    n = F.sum(F.greatest(F.lit(1), F.floor(F.length("text") / 4)))
    rate = F.when(F.max("role").contains("user"), 0.27).otherwise(0.5)
    return t.conversations.groupBy("conv_id").agg(_long(n).alias("tokens"), F.round(n * rate / 1_000_000, 9).alias("cost"))


@query("SELECT conv_id, lower(string_agg(role || ': ' || text, ' ' ORDER BY turn, role, text)) AS blob, count(*)::BIGINT AS n FROM conversations GROUP BY conv_id")
def conversation_blob(t: Tables) -> DataFrame:
    rows = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    got = t.conversations.groupBy("conv_id").agg(rows.alias("r"), F.count(F.lit(1)).alias("n"))
    return got.select("conv_id", F.lower(F.array_join(F.transform("r", lambda x: F.concat(x["role"], F.lit(": "), x["text"])), " ")).alias("blob"), "n")


_TOK = "list_distinct(regexp_extract_all(lower(text), '[a-z0-9][a-z0-9+.#-]{2,}'))"


@query(f"""WITH s AS (SELECT doc_id, {_TOK} AS tokens FROM documents WHERE length(text) >= 25), e AS (SELECT doc_id, len(tokens) AS n, unnest(tokens) AS token FROM s),
  c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common, any_value(a.n + b.n) AS both_n FROM e a JOIN e b ON a.token = b.token AND a.doc_id < b.doc_id AND least(a.n, b.n) >= 0.58 * greatest(a.n, b.n) GROUP BY 1, 2)
  SELECT a, b, common::BIGINT AS common, (both_n - common)::BIGINT AS total FROM c WHERE common >= 0.58 * (both_n - common)""")
def near_dup_pairs(t: Tables) -> DataFrame:
    tokens = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("([a-z0-9][a-z0-9+.#-]{2,})"), F.lit(1)))
    return dedupe.near_pairs(t.documents.where(F.length("text") >= 25).select(F.col("doc_id").alias("id"), tokens.alias("tokens")), 0.58)


@query(f"""WITH RECURSIVE s AS (SELECT doc_id, list_sort({_TOK}) AS tokens FROM documents WHERE length(text) >= 25), g AS MATERIALIZED (SELECT tokens, min(doc_id) AS id, count(*) AS n FROM s WHERE len(tokens) > 0 GROUP BY tokens),
  x AS (SELECT id, len(tokens) AS n, unnest(tokens) AS token FROM g),
  c AS (SELECT a.id AS a, b.id AS b, count(*) AS common, any_value(a.n + b.n) AS both_n FROM x a JOIN x b ON a.token = b.token AND a.id <> b.id AND least(a.n, b.n) >= 0.58 * greatest(a.n, b.n) GROUP BY 1, 2),
  e AS MATERIALIZED (SELECT a, b FROM c WHERE common >= 0.58 * (both_n - common)), reach(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM reach r JOIN e ON r.b = e.a),
  low AS (SELECT a, min(b) AS m FROM reach GROUP BY a), k AS (SELECT e.a, sum(g.n) AS n FROM e JOIN g ON g.id = e.b GROUP BY e.a)
  SELECT s.doc_id, least(coalesce(low.m, g.id), coalesce(g.id, s.doc_id)) AS class_id, (coalesce(g.n, 1) - 1 + coalesce(k.n, 0))::BIGINT AS n_links FROM s LEFT JOIN g ON g.tokens = s.tokens LEFT JOIN low ON low.a = g.id LEFT JOIN k ON k.a = g.id""")
def near_dup_classes(t: Tables) -> DataFrame:
    """Near-duplicate classes of documents with link counts: what near_dup_pairs says, without a row a pair."""
    tokens = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("([a-z0-9][a-z0-9+.#-]{2,})"), F.lit(1)))
    got = dedupe.near_classes(t.documents.where(F.length("text") >= 25).select(F.col("doc_id").alias("id"), tokens.alias("tokens")), 0.58)
    return got.select(F.col("id").alias("doc_id"), "class_id", "n_links")


def _in(words: tuple[str, ...]) -> str:
    return ", ".join(f"'{w}'" for w in words)


def _features(text: str) -> str:
    """SQL of tokens, signals, themes, size and score of a text."""
    tokens = rf"list_sort(list_distinct(list_filter(list_transform(regexp_extract_all(lower({text}), '[a-z0-9][a-z0-9+.#-]{{2,}}'), lambda x: string_split(trim(x, '.-+'), '.')[1]), lambda x: length(x) >= 3 AND x NOT IN ({_in(greedy.STOP)}))))"
    signals = rf"list_sort(list_distinct(list_filter(regexp_split_to_array(lower({text}), '[^\p{{L}}\p{{N}}_]+'), lambda w: w IN ({_in(ranking.SIGNALS)}))))"
    return f"{tokens} AS tokens, {signals} AS signals, length({text})::BIGINT AS size, {score(text)} AS score"


_HAS = "list_has_any({0}, [{1}])"
_THEMES = (
    f"CASE WHEN {_HAS.format('tokens', _in(greedy.ACCESS))} THEN list_transform(list_filter(tokens, lambda x: x IN ({_in(greedy.STACKS)})), lambda x: 'access:' || x) ELSE [] END || "
    f"CASE WHEN NOT {_HAS.format('tokens', _in(greedy.INTEGRATION))} THEN [] " + " ".join(f"WHEN {_HAS.format('tokens', _in(w))} THEN ['integration:{n}']" for n, w in greedy.SUBTHEMES.items()) + " ELSE [] END AS themes")


def _near(a: str, b: str) -> str:
    common, both = f"len(list_intersect({a}.tokens, {b}.tokens))", f"len(list_intersect({a}.signals, {b}.signals))"
    share = f"({common} / (len({a}.tokens) + len({b}.tokens) - {common}))"
    return (
        f"(len({a}.tokens) > 0 AND len({b}.tokens) > 0 AND ({share} >= 0.58 OR ({common} >= 5 AND {share} >= 0.42) OR ({both} >= 2 AND {share} >= 0.28)"
        f" OR ({both} >= 2 AND {a}.signals = {b}.signals AND {share} >= 0.18) OR list_has_any({a}.themes, {b}.themes)))")


def _better(new: str, old: str) -> str:
    return f"({new}.score > {old}.score OR ({new}.size > {old}.size + 20 AND {new}.score >= {old}.score - 0.5))"


@query(f"""WITH RECURSIVE {LINE}, f AS (SELECT doc_id, ln, {_features('line')} FROM line WHERE length(line) >= 25), t AS (SELECT *, {_THEMES} FROM f),
  l AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ln) AS k FROM t),
  e AS MATERIALIZED (SELECT b.doc_id, b.k, list(a.k) AS met, list(a.k) FILTER ({_better('b', 'a')}) AS won FROM l a JOIN l b ON a.doc_id = b.doc_id AND a.k < b.k AND {_near('a', 'b')} GROUP BY b.doc_id, b.k),
  i AS MATERIALIZED (SELECT l.doc_id, l.k, coalesce(met, []) AS met, coalesce(won, []) AS won FROM l LEFT JOIN e ON e.doc_id = l.doc_id AND e.k = l.k),
  z AS (SELECT doc_id, k, [k] AS kept FROM i WHERE k = 1 UNION ALL
    SELECT i.doc_id, i.k, CASE WHEN len(hit) = 0 THEN z.kept || [i.k] WHEN list_contains(i.won, hit[1]) THEN list_transform(z.kept, lambda h: CASE WHEN h = hit[1] THEN i.k ELSE h END) ELSE z.kept END
    FROM z JOIN i ON i.doc_id = z.doc_id AND i.k = z.k + 1, LATERAL (SELECT list_filter(z.kept, lambda h: list_contains(i.met, h)) AS hit)),
  r AS (SELECT doc_id, unnest(arg_max(kept, k)) AS k FROM z GROUP BY doc_id)
  SELECT l.doc_id, l.ln AS pos, l.score FROM r JOIN l ON l.doc_id = r.doc_id AND l.k = r.k""")
def near_dup_collapse(t: Tables) -> DataFrame:
    """Greedy collapse of each document's lines, in line order, with signals and themes."""
    items = greedy.featured(L.lines(t.documents), F.col("line"), ranking.line_score(F.col("line")), "doc_id", F.col("ln").alias("pos"))
    return greedy.collapse_groups(items, "doc_id")


@query(f"""WITH RECURSIVE f AS (SELECT doc_id, {_features('text')} FROM documents WHERE length(text) >= 25), d AS MATERIALIZED (SELECT *, {_THEMES} FROM f),
  o AS MATERIALIZED (SELECT *, min(doc_id) OVER (PARTITION BY tokens, signals, score, size, CASE WHEN len(tokens) = 0 THEN doc_id END) AS first FROM d),
  l AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY doc_id) AS k FROM o WHERE first = doc_id),
  x AS (SELECT k, len(tokens) AS n, unnest(tokens) AS token FROM l), y AS (SELECT k, unnest(themes) AS theme FROM l),
  p AS (SELECT a.k AS a, b.k AS b FROM x a JOIN x b ON a.token = b.token AND a.k < b.k GROUP BY 1, 2 HAVING count(*) >= 0.17 * (any_value(a.n + b.n) - count(*)) UNION SELECT a.k, b.k FROM y a JOIN y b ON a.theme = b.theme AND a.k < b.k),
  e AS MATERIALIZED (SELECT b.k, list(a.k) AS met, list(a.k) FILTER ({_better('b', 'a')}) AS won FROM p JOIN l a ON a.k = p.a JOIN l b ON b.k = p.b WHERE {_near('a', 'b')} GROUP BY b.k),
  i AS MATERIALIZED (SELECT l.k, coalesce(met, []) AS met, coalesce(won, []) AS won FROM l LEFT JOIN e ON e.k = l.k),
  z AS (SELECT k, [{{'s': k, 'h': k}}] AS kept, k AS slot FROM i WHERE k = 1 UNION ALL
    SELECT i.k, CASE WHEN len(hit) = 0 THEN z.kept || [{{'s': i.k, 'h': i.k}}] WHEN list_contains(i.won, hit[1].h) THEN list_transform(z.kept, lambda q: CASE WHEN q.s = hit[1].s THEN {{'s': q.s, 'h': i.k}} ELSE q END) ELSE z.kept END,
      CASE WHEN len(hit) = 0 THEN i.k ELSE hit[1].s END
    FROM z JOIN i ON i.k = z.k + 1, LATERAL (SELECT list_filter(z.kept, lambda q: list_contains(i.met, q.h)) AS hit)),
  r AS (SELECT unnest(arg_max(kept, k)).h AS k FROM z)
  SELECT o.doc_id, s.doc_id AS slot, o.doc_id = o.first AND r.k IS NOT NULL AS kept FROM o JOIN l ON l.doc_id = o.first JOIN z ON z.k = l.k JOIN l s ON s.k = z.slot LEFT JOIN r ON r.k = l.k""")
def near_dup_greedy(t: Tables) -> DataFrame:
    """Greedy keep-better choice among all documents, by rounds."""
    items = greedy.featured(t.documents, F.col("text"), ranking.line_score(F.col("text")), F.col("doc_id").alias("id"))
    return greedy.choose(items).select(F.col("id").alias("doc_id"), "slot", "kept")


# ---------------------------------------------------------------- ranking


@query(f"WITH {LINE} SELECT doc_id, ln, {score('line')} AS score FROM line")
def line_score(t: Tables) -> DataFrame:
    return L.lines(t.documents).select("doc_id", "ln", ranking.line_score(F.col("line")).alias("score"))


@query(f"WITH {LINE}, s AS (SELECT doc_id, ln, {squash('line')} AS line, {score('line')} AS score FROM line) SELECT doc_id, ln, line, score, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, ln)::BIGINT AS rank FROM s QUALIFY rank <= 3")
def topk_lines(t: Tables) -> DataFrame:
    scored = L.lines(t.documents).select("doc_id", "ln", T.squash(F.col("line")).alias("line"), ranking.line_score(F.col("line")).alias("score"))
    return ranking.top_k(scored, ["doc_id"], 3, [F.desc("score"), F.col("ln")])


@query(f"""WITH {LINE}, s AS (SELECT doc_id, ln, {score('line')} AS score, regexp_matches(line, '[0-9]') AS must_keep FROM line WHERE length(line) >= 25)
  SELECT doc_id, ln, score, must_keep, row_number() OVER (PARTITION BY doc_id ORDER BY must_keep::INT DESC, score DESC, ln)::BIGINT AS rank FROM s QUALIFY rank <= 4""")
def topk_with_quota(t: Tables) -> DataFrame:
    rows = L.lines(t.documents).where("length(line) >= 25")
    return ranking.with_must_keep(rows, 4, ranking.line_score(F.col("line")), F.col("line").rlike("[0-9]")).select("doc_id", "ln", "score", "must_keep", "rank")


@query("""WITH li AS (SELECT l_orderkey, count(*) * 3 AS available FROM lineitem GROUP BY 1), o AS (SELECT o_custkey, o_orderkey, o_orderdate, coalesce(available, 0) AS available FROM orders LEFT JOIN li ON l_orderkey = o_orderkey),
  r AS (SELECT *, row_number() OVER w::BIGINT AS rank, count(*) OVER (PARTITION BY o_custkey) AS n FROM o WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey)),
  q AS (SELECT *, greatest(6, least(24, round_even(70 * (n - rank + 1) / (n * (n + 1) / 2), 0)))::BIGINT AS q FROM r),
  b AS (SELECT *, q - greatest(0, least(q - 6, sum(q) OVER (PARTITION BY o_custkey) - 70 - coalesce(sum(q - 6) OVER (PARTITION BY o_custkey ORDER BY rank ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0))) AS kept FROM q),
  s AS (SELECT *, sum(kept) OVER (PARTITION BY o_custkey) AS total, least(70, sum(available) OVER (PARTITION BY o_custkey)) AS goal, least(24, available) - kept AS room FROM b),
  e AS (SELECT o_custkey, o_orderkey, rank, total, goal, unnest(range(1, greatest(room, 0)::BIGINT + 1)) AS k FROM s),
  g AS (SELECT o_orderkey, (total + row_number() OVER (PARTITION BY o_custkey ORDER BY k, rank) - 1 < 70 AND total + (SELECT count(*) FROM e f WHERE f.o_custkey = e.o_custkey AND f.k < e.k) < goal) AS given FROM e),
  a AS (SELECT o_orderkey, count(*) FILTER (given) AS more FROM g GROUP BY 1)
  SELECT s.o_custkey, s.o_orderkey, s.rank, (s.kept + coalesce(a.more, 0))::BIGINT AS quota, CASE WHEN rank <= 1 THEN 12 WHEN rank = 2 THEN 11 WHEN rank <= 4 THEN 10 WHEN rank <= 6 THEN 8 ELSE 6 END::BIGINT AS cap FROM s LEFT JOIN a ON a.o_orderkey = s.o_orderkey""")
def recency_quota(t: Tables) -> DataFrame:
    """Quotas of each customer's orders in a budget of 70, newest first; an order can use three a line item."""
    li = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg((F.count(F.lit(1)) * 3).alias("available"))
    orders = t.orders.select("o_custkey", "o_orderkey", "o_orderdate").join(li, "o_orderkey", "left").withColumn("available", F.coalesce("available", F.lit(0)))
    got = ranking.recency_quota(orders, "o_custkey", [F.desc("o_orderdate"), F.col("o_orderkey")], "available", 70)
    return got.select("o_custkey", "o_orderkey", "rank", "quota", ranking.recency_caps(F.col("rank") - 1).alias("cap"))


@query(f"""WITH {LINE}, s AS (SELECT source, doc_id, sum({score('line')}) + least(3.0::DOUBLE, 0.4::DOUBLE * count(*)) AS score FROM line GROUP BY source, doc_id)
  SELECT source, doc_id, round(score, 6) AS score FROM s QUALIFY row_number() OVER (PARTITION BY source ORDER BY round(score, 6) DESC, doc_id) <= 5""")
def topk_documents_per_source(t: Tables) -> DataFrame:
    s = L.lines(t.documents, "source").groupBy("source", "doc_id").agg(F.round(F.sum(ranking.line_score(F.col("line"))) + F.least(F.lit(3.0), 0.4 * F.count(F.lit(1))), 6).alias("score"))
    return ranking.top_k(s, ["source"], 5, [F.desc("score"), F.col("doc_id")]).drop("rank")


@query("""SELECT n.n_nationkey, n.n_name, coalesce(r.rank, 999)::BIGINT AS place FROM nation n LEFT JOIN (VALUES ('NATION_3', 1), ('NATION_1', 2), ('NATION_7', 3)) r(n_name, rank) ON r.n_name = n.n_name""")
def ordered_sections(t: Tables) -> DataFrame:
    ranks = t.spark.createDataFrame([("NATION_3", 1), ("NATION_1", 2), ("NATION_7", 3)], "n_name string, rank long")
    return ranking.in_order(t.nation, ranks, "n_name").select("n_nationkey", "n_name", "place")


@query("""WITH o AS (SELECT r_regionkey, unnest(list_value('NATION_' || (r_regionkey + 5), 'NATION_' || r_regionkey, 'NATION_' || (r_regionkey + 5), 'NATION_0', 'NATION_1', 'NATION_2')) AS section, generate_subscripts(list_value(1, 2, 3, 4, 5, 6), 1) AS p FROM region),
  f AS (SELECT r_regionkey, section, min(p) AS p FROM o GROUP BY ALL), k AS (SELECT r_regionkey, section, row_number() OVER (PARTITION BY r_regionkey ORDER BY p)::BIGINT AS pos FROM f)
  SELECT k.r_regionkey::BIGINT AS doc_id, k.pos, k.section, 'region ' || n.n_regionkey AS content FROM k JOIN nation n ON n.n_name = k.section""")
def ordered_assembly(t: Tables) -> DataFrame:
    name = lambda plus: F.concat(F.lit("NATION_"), (F.col("r_regionkey") + plus).cast("string"))
    order = t.region.select(_long(F.col("r_regionkey")).alias("doc_id"), F.array(name(5), name(0), name(5)).alias("order"))
    payload = (
        order.select("doc_id", F.explode(F.concat("order", F.array(*[F.lit(f"NATION_{i}") for i in range(3)]))).alias("n_name")).distinct().join(t.nation, "n_name").select("doc_id", F.col("n_name").alias("section"), F.concat(F.lit("region "), "n_regionkey").alias("content"))
    )
    return ranking.assemble(order, payload, ["NATION_0", "NATION_1", "NATION_2"])


@query("SELECT p_partkey, p_type, p_size, CASE p_type WHEN 'ECONOMY' THEN 0 WHEN 'PROMO' THEN 1 ELSE 2 END::BIGINT AS level FROM part ORDER BY level, p_size DESC, p_partkey")
def level_sort(t: Tables) -> DataFrame:
    """All rows in order: a range-partitioned sort."""
    level = F.when(F.col("p_type") == "ECONOMY", 0).when(F.col("p_type") == "PROMO", 1).otherwise(2)
    return t.part.select("p_partkey", "p_type", "p_size", _long(level).alias("level")).orderBy("level", F.desc("p_size"), "p_partkey")


@query("""SELECT o_custkey, o_orderpriority, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate DESC, o_orderkey) <= CASE o_orderpriority WHEN '1-URGENT' THEN 2 WHEN '2-HIGH' THEN 1 ELSE 1000000 END""")
def list_caps(t: Tables) -> DataFrame:
    return ranking.capped(t.orders, {"1-URGENT": 2, "2-HIGH": 1}, "o_orderpriority", [F.desc("o_orderdate"), F.col("o_orderkey")], ["o_custkey"]).select("o_custkey", "o_orderpriority", "o_orderkey")
