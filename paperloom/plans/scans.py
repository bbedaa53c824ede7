"""Scans, projections, filters and scalar functions."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import glossary, items, spacing
from ..functions import text as T
from ..operators.lines import lines
from ..operators.observed import Stages
from ..operators.ranking import any_word
from ..session import shared_path, written
from ..sources import files, profiles
from ..sources.tables import Tables
from .registry import LINE, key, query, squash, words


def _long(c: F.Column) -> F.Column:
    return c.cast("long")


@query("SELECT doc_id, source, n_chars FROM documents WHERE n_chars BETWEEN 1 AND 10000 AND source IN ('src0','src1','src2','src3','src4')")
def admit_documents(t: Tables) -> DataFrame:
    return t.documents.where(F.col("n_chars").between(1, 10_000) & F.col("source").isin("src0", "src1", "src2", "src3", "src4")).select("doc_id", "source", "n_chars")


@query(f"WITH {LINE} SELECT doc_id, ln, line FROM line")
def line_explode(t: Tables) -> DataFrame:
    return lines(t.documents)


@query("SELECT page_id, coalesce(nullif(trim(regexp_extract(html, '<h2>([^<]*)</h2>', 1)), ''), nullif(trim(regexp_extract(html, '<h1>([^<]*)</h1>', 1)), ''), '') AS text FROM pages")
def extract_fallback(t: Tables) -> DataFrame:
    h = lambda n: F.regexp_extract("html", f"<h{n}>([^<]*)</h{n}>", 1)
    return t.pages.select("page_id", F.coalesce(T.blank_to_null(F.trim(h(2))), T.blank_to_null(F.trim(h(1))), F.lit("")).alias("text"))


@query("""SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, len(regexp_extract_all(html, '<h[1-6]>'))::BIGINT AS n_headings,
  len(regexp_extract_all(html, '<a href='))::BIGINT AS n_links, CASE WHEN html LIKE '%<article>%' THEN 'high' WHEN html LIKE '%<p>%' THEN 'medium' ELSE 'low' END AS confidence FROM pages""")
def page_title_profile(t: Tables) -> DataFrame:
    count = lambda p: _long(F.size(F.regexp_extract_all("html", F.lit(f"({p})"), F.lit(1))))
    return t.pages.select(
        "page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), count("<h[1-6]>").alias("n_headings"), count("<a href=").alias("n_links"),
        F.when(F.col("html").contains("<article>"), "high").when(F.col("html").contains("<p>"), "medium").otherwise("low").alias("confidence"))


@query(r"""SELECT page_id, regexp_replace(regexp_replace(regexp_replace(url, '\\', '/', 'g'), '^/+', ''), '[^a-zA-Z0-9._/-]', '_', 'g') AS object_key,
  regexp_replace(url, '[^a-zA-Z0-9._-]', '_', 'g') AS file_name FROM pages""")
def object_keys(t: Tables) -> DataFrame:
    return t.pages.select("page_id", T.object_key(F.col("url")).alias("object_key"), T.file_name(F.col("url")).alias("file_name"))


@query("SELECT page_id, substring(html, 1, 240) AS preview, length(html)::BIGINT AS n FROM pages ORDER BY n DESC, page_id")
def profile_listing(t: Tables) -> DataFrame:
    """All pages with a preview, the longest first."""
    return t.pages.select("page_id", F.substring("html", 1, 240).alias("preview"), _long(F.length("html")).alias("n")).orderBy(F.desc("n"), "page_id")


@query(r"""WITH d AS (SELECT doc_id, CASE doc_id % 10 WHEN 0 THEN 'docx' WHEN 1 THEN 'dat' ELSE 'txt' END AS suffix, coalesce(text, '') AS text FROM documents),
  l AS (SELECT doc_id, trim(x, ' ' || chr(9) || chr(13)) AS x, p FROM (SELECT doc_id, unnest(string_split(regexp_replace(text, '[\x00-\x08\x0B\x0C\x0E-\x1F]', '', 'g'), chr(10))) AS x, generate_subscripts(string_split(regexp_replace(text, '[\x00-\x08\x0B\x0C\x0E-\x1F]', '', 'g'), chr(10)), 1) AS p FROM d WHERE suffix = 'docx')),
  j AS (SELECT doc_id, string_agg(x, chr(10) ORDER BY p) AS text FROM l WHERE x <> '' GROUP BY doc_id)
  SELECT d.doc_id, d.suffix, CASE WHEN d.suffix = 'docx' THEN coalesce(j.text, '') ELSE regexp_replace(d.text, '^\s+|\s+$', '', 'g') END AS text FROM d LEFT JOIN j USING (doc_id) WHERE d.suffix = 'docx' OR (d.suffix = 'txt' AND strlen(d.text) BETWEEN 1 AND 10000000)""")
def file_round_trip(t: Tables) -> DataFrame:
    """All documents written as files (.docx, .txt and an unknown kind) and read back; suffix and length are filtered before a file is opened."""
    files.register(t.spark)
    folder = shared_path(t.spark, "documents")
    kind = F.when(F.col("doc_id") % 10 == 0, "docx").when(F.col("doc_id") % 10 == 1, "dat").otherwise("txt")
    t.documents.select(F.concat(F.col("doc_id").cast("string"), F.lit("."), kind).alias("name"), "text").write.format("documents").mode("append").save(folder)
    got = t.spark.read.format("documents").load(folder).where(F.col("suffix").isin("docx", "txt") & F.col("length").between(1, 10_000_000))
    return got.select(_long(F.regexp_extract("path", r"([0-9]+)\.[a-z]+$", 1)).alias("doc_id"), "suffix", "text")


@query("""SELECT section, rank::BIGINT AS rank, label FROM (VALUES ('summary',1,'Summary'),('skills',2,'Skill Set Overview'),('education',3,'Education'),
  ('certifications',4,'Certifications'),('experience',5,'Experience')) v(section, rank, label)""")
def template_sections(t: Tables) -> DataFrame:
    return profiles.built_in(t.spark)


@query("SELECT p_partkey, list_filter(list_transform(string_split(p_name || ', ,' || p_type, ','), lambda x: trim(x)), lambda x: x <> '')[1] AS first, len(list_filter(list_transform(string_split(p_name || ', ,' || p_type, ','), lambda x: trim(x)), lambda x: x <> ''))::BIGINT AS n FROM part")
def settings_list(t: Tables) -> DataFrame:
    parts = F.filter(F.transform(F.split(F.concat("p_name", F.lit(", ,"), "p_type"), ","), lambda x: F.trim(x)), lambda x: x != "")
    return t.part.select("p_partkey", parts[0].alias("first"), _long(F.size(parts)).alias("n"))


@query("SELECT page_id, strlen(html)::BIGINT AS n_bytes, upper(hex(encode(substring(html, 1, 4)))) AS magic FROM pages WHERE strlen(html) BETWEEN 200 AND 5000000")
def byte_range_filter(t: Tables) -> DataFrame:
    n = _long(F.octet_length("html"))
    return t.pages.where(n.between(200, 5_000_000)).select("page_id", n.alias("n_bytes"), F.hex(F.substring("html", 1, 4).cast("binary")).alias("magic"))


@query("SELECT count(*)::BIGINT AS n_docs, count(text)::BIGINT AS n_texts, coalesce(sum(length(text)), 0)::BIGINT AS n_chars, count(DISTINCT source)::BIGINT AS n_sources FROM documents")
def stage_counters(t: Tables) -> DataFrame:
    return t.documents.agg(F.count(F.lit(1)).alias("n_docs"), F.count("text").alias("n_texts"), _long(F.coalesce(F.sum(F.length("text")), F.lit(0))).alias("n_chars"), F.countDistinct("source").alias("n_sources"))


@query(f"""WITH {LINE}, c AS (SELECT doc_id, ln, line FROM line WHERE length(line) >= 25), d AS (SELECT doc_id, line, count(*) AS n FROM c GROUP BY doc_id, line)
  SELECT stage, metric, value::BIGINT AS value FROM (SELECT 'lines' AS stage, 'n_rows' AS metric, count(*) AS value FROM line UNION ALL SELECT 'lines', 'n_chars', sum(length(line)) FROM line
  UNION ALL SELECT 'long', 'n_rows', count(*) FROM c UNION ALL SELECT 'long', 'longest', max(length(line)) FROM c UNION ALL SELECT 'distinct', 'n_rows', count(*) FROM d UNION ALL SELECT 'distinct', 'n_repeats', sum(n - 1) FROM d)""")
def observed_stages(t: Tables) -> DataFrame:
    """What three stages of one run have seen, gathered while it ran."""
    stages = Stages()
    every = stages.mark(lines(t.documents), "lines", n_chars=F.sum(F.length("line")))
    long = stages.mark(every.where(F.length("line") >= 25), "long", longest=F.max(F.length("line")))
    once = stages.mark(long.groupBy("doc_id", "line").agg(F.count(F.lit(1)).alias("n")), "distinct", n_repeats=F.sum(F.col("n") - 1))
    written(once)
    return stages.rows(t.spark).drop("place")


@query(rf"""SELECT doc_id, regexp_replace(regexp_replace(text, '{T.EMAIL}', '[EMAIL]', 'g'), '{T.PHONES[0]}', '[PHONE]', 'g') AS text FROM documents
  WHERE regexp_matches(text, '{T.EMAIL}') OR regexp_matches(text, '{T.PHONES[0]}')""")
def pii_mask(t: Tables) -> DataFrame:
    some = t.documents.where(F.col("text").rlike(T.EMAIL) | F.col("text").rlike(T.PHONES[0]))
    return some.select("doc_id", F.regexp_replace(F.regexp_replace("text", T.EMAIL, "[EMAIL]"), T.PHONES[0], "[PHONE]").alias("text"))


_SQ = squash("line")


@query(f"""WITH {LINE} SELECT doc_id, ln, {_SQ} AS heading FROM line WHERE {_SQ} <> '' AND len({words(_SQ)}) <= 6 AND length({_SQ}) < 40
  AND NOT regexp_matches({_SQ}, '[.!?,;:]$') AND regexp_matches({_SQ}, '[A-Za-z]')""")
def heading_lines(t: Tables) -> DataFrame:
    return lines(t.documents).where(T.is_heading(F.col("line"))).select("doc_id", "ln", T.squash(F.col("line")).alias("heading"))


@query(rf"""WITH {LINE} SELECT doc_id, ln, line FROM line WHERE NOT (regexp_matches(lower(line), 'licensed under|all rights reserved|copyright|cookie|terms of (use|service)|subscribe')
  OR regexp_matches(lower(line), '^\s*(e-?mail|phone|tel|address)\s*:') OR regexp_matches(line, '^\s*https?://[^\s]+\s*$') OR length(line) - length(regexp_replace(line, '[|•]', '', 'g')) >= 2)""")
def noise_filter(t: Tables) -> DataFrame:
    return lines(t.documents).where(~T.is_noise(F.col("line")))


@query(rf"""WITH {LINE} SELECT doc_id, ln, line FROM line WHERE (length(line) - length(regexp_replace(line, '\(', '', 'g')) >= 2 AND length(line) - length(regexp_replace(line, '\)', '', 'g')) >= 2
  AND length(line) > 80 AND regexp_matches(line, '[a-z]\.[a-z]+\(')) OR regexp_matches(line, '[{{}};]\s*$|^\s*(sudo|pip|npm|git) |</?[a-z]+>')
  OR length(regexp_replace(line, '[^#$%&*<>|!]', '', 'g')) * 4 > length(line)""")
def garbage_lines(t: Tables) -> DataFrame:
    return lines(t.documents).where(T.is_garbage(F.col("line")))


_J = squash(r"regexp_replace(line, '\b(Jr|Sr|Dr)\.', '\1', 'g')")


@query(rf"""WITH {LINE}, k AS (SELECT doc_id, {_J} AS t FROM line)
  SELECT doc_id, CASE WHEN t = '' THEN 'blank' WHEN regexp_matches(t, '^[A-Z][A-Za-z]+, [A-Z]{{2}}$') THEN 'location'
  WHEN length(t) > 110 OR contains(t, '. ') OR regexp_matches(t, '^[a-z]') OR len({words("t")}) >= 14 OR (regexp_matches(t, '\.$') AND len({words("t")}) >= 6) THEN 'sentence' ELSE 'title' END AS kind,
  count(*)::BIGINT AS n FROM k GROUP BY ALL""")
def line_kinds(t: Tables) -> DataFrame:
    return lines(t.documents).select("doc_id", T.title_kind(F.col("line")).alias("kind")).groupBy("doc_id", "kind").agg(F.count(F.lit(1)).alias("n"))


@query(rf"""WITH tok AS (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS token FROM part)
  SELECT p_partkey, token FROM tok WHERE NOT regexp_matches(lower(token), '^(n/?a|none|nil)$|@|https?:') AND length(token) BETWEEN 2 AND 70 AND NOT regexp_matches(token, ':$')""")
def skill_tokens(t: Tables) -> DataFrame:
    tok = t.part.select("p_partkey", F.explode(F.split("p_name", " ")).alias("token"))
    return tok.where(~F.lower("token").rlike("^(n/?a|none|nil)$|@|https?:") & F.length("token").between(2, 70) & ~F.col("token").rlike(":$"))


@query(r"""SELECT doc_id, length(text) >= 40 AND length(regexp_replace(text, '[^A-Za-z]', '', 'g')) >= 40 AND (length(regexp_replace(text, '[^ ]', '', 'g')) / length(regexp_replace(text, '[^A-Za-z]', '', 'g')) < 0.08
  OR len(regexp_extract_all(text, '[A-Za-z]{22,}')) >= 2) AS mashed FROM documents""")
def mashed_text_flag(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", T.is_mashed(F.col("text")).alias("mashed"))


@query("""SELECT l_orderkey, count(*)::BIGINT AS n_lines, sum(l_quantity)::DOUBLE AS quantity, count(*) >= 5 OR sum(l_quantity) >= 150 AS is_large FROM lineitem GROUP BY l_orderkey""")
def size_class(t: Tables) -> DataFrame:
    n, q = F.count(F.lit(1)), F.sum("l_quantity")
    return t.lineitem.groupBy("l_orderkey").agg(n.alias("n_lines"), q.alias("quantity"), ((n >= 5) | (q >= 150)).alias("is_large"))


@query(f"SELECT doc_id, substring(text, 1, 600) AS head, len(list_slice({words('text')}, 1, 20))::BIGINT AS n_head_words, array_to_string(list_slice({words('text')}, 1, 20), ' ') AS head_words FROM documents")
def truncated_projection(t: Tables) -> DataFrame:
    head = F.slice(T.words(F.col("text")), 1, 20)
    return t.documents.select("doc_id", F.substring("text", 1, 600).alias("head"), _long(F.size(head)).alias("n_head_words"), F.array_join(head, " ").alias("head_words"))


@query("""SELECT c.c_custkey, coalesce(nullif(trim(max(o.o_orderpriority) FILTER (o.o_orderstatus = 'F')), ''), nullif(trim(c.c_mktsegment), ''), 'none') AS label
  FROM customer c LEFT JOIN orders o ON o.o_custkey = c.c_custkey GROUP BY c.c_custkey, c.c_mktsegment""")
def truthy_coalesce(t: Tables) -> DataFrame:
    best = t.orders.where("o_orderstatus = 'F'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderpriority").alias("p"))
    return t.customer.join(best, "c_custkey", "left").select("c_custkey", T.first_truthy(F.col("p"), F.col("c_mktsegment"), F.lit("none")).alias("label"))


@query(rf"""SELECT doc_id, regexp_matches(lower(text), '\b(licen[sc]e|rights)\b') AS has_license, regexp_matches(text, '{T.YEAR}') AS has_year, regexp_matches(text, '[0-9]{{6,}}') AS has_long_number FROM documents""")
def keyword_flags(t: Tables) -> DataFrame:
    c = F.col("text")
    return t.documents.select("doc_id", F.lower(c).rlike(r"\b(licen[sc]e|rights)\b").alias("has_license"), c.rlike(T.YEAR).alias("has_year"), c.rlike("[0-9]{6,}").alias("has_long_number"))


@query(r"""WITH h AS (SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title FROM pages)
  SELECT page_id, title, length(title) <= 55 AND NOT contains(title, '@') AND NOT regexp_matches(title, '[0-9]{7,}') AND NOT regexp_matches(lower(title), '\b(inc|llc|ltd)\b') AS valid FROM h""")
def title_audit(t: Tables) -> DataFrame:
    h = t.pages.select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"))
    c = F.col("title")
    return h.withColumn("valid", (F.length(c) <= 55) & ~c.contains("@") & ~c.rlike("[0-9]{7,}") & ~F.lower(c).rlike(r"\b(inc|llc|ltd)\b"))


_TOOLS = any_word(T.TOOL_WORDS)


@query(rf"""SELECT doc_id, array_to_string(list_slice(list_filter(list_transform(string_split(regexp_replace(text, '\s+', ' ', 'g'), ','), lambda x: trim(x)),
  lambda x: x <> '' AND length(x) <= 40 AND len(string_split(x, ' ')) <= 5 AND NOT regexp_matches(lower(x), '{_TOOLS}')), 1, 8), ',') AS names FROM documents""")
def first_eight_names(t: Tables) -> DataFrame:
    """The first eight entries of a comma-separated list that are short (40 characters, five words) and name no tool."""
    items = F.transform(F.split(F.regexp_replace("text", r"\s+", " "), ","), lambda x: F.trim(x))
    short = F.filter(items, lambda x: (x != "") & (F.length(x) <= 40) & (F.size(F.split(x, " ")) <= 5) & ~F.lower(x).rlike(_TOOLS))
    return t.documents.select("doc_id", F.array_join(F.slice(short, 1, 8), ",").alias("names"))


_BLED = any_word(T.BLEED_WORDS)


@query(rf"WITH {LINE} SELECT doc_id, ln, line FROM line WHERE NOT regexp_matches(lower(line), '{_BLED}') AND NOT regexp_full_match(lower(trim(line)), 'specialization(\s*\([^)]*\))?')")
def bleed_filter(t: Tables) -> DataFrame:
    """Lines that have not bled in from another section, and are no bare fragments."""
    line = F.col("line")
    return lines(t.documents).where(~F.lower(line).rlike(_BLED) & ~F.lower(F.trim(line)).rlike(r"^specialization(\s*\([^)]*\))?$")).select("doc_id", "ln", "line")


@query("""SELECT n.n_nationkey, n.n_name, coalesce(s.n, 0)::BIGINT AS n_suppliers, s.n IS NULL AS backfilled FROM nation n LEFT JOIN (SELECT s_nationkey, count(*) AS n FROM supplier WHERE s_acctbal > 0 GROUP BY 1) s ON s.s_nationkey = n.n_nationkey""")
def drop_empty_backfill(t: Tables) -> DataFrame:
    s = t.supplier.where("s_acctbal > 0").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count(F.lit(1)).alias("n"))
    return t.nation.join(s, "n_nationkey", "left").select("n_nationkey", "n_name", _long(F.coalesce("n", F.lit(0))).alias("n_suppliers"), F.col("n").isNull().alias("backfilled"))


@query(f"SELECT doc_id, {key('text')} AS text_key FROM documents")
def norm_text_key(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", T.alnum_key(F.col("text")).alias("text_key"))


@query(f"SELECT doc_id, {squash('text')} AS text FROM documents")
def squashed_text(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", T.squash(F.col("text")).alias("text"))


@query(r"""WITH p AS (SELECT p_partkey, string_split(regexp_replace(regexp_replace(p_name || ' of ' || p_type || ':', '_', ' ', 'g'), '[:：\s]+$', ''), ' ') AS w FROM part)
  SELECT p_partkey, array_to_string(list_transform(w, lambda x, i: CASE WHEN regexp_matches(x, '^[A-Z]{2,4}$') THEN x WHEN i > 1 AND lower(x) IN ('of','and','the','in','for','to','a') THEN lower(x)
  ELSE upper(substring(x, 1, 1)) || substring(lower(x), 2) END), ' ') AS title FROM p""")
def title_case(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", T.title_case(F.concat("p_name", F.lit(" of "), "p_type", F.lit(":"))).alias("title"))


@query("""WITH c AS (SELECT p_partkey, '#' || upper(printf('%06x', (p_partkey * 7919) % 16777216)) AS color FROM part)
  SELECT p_partkey, color, ('0x' || substring(color, 2, 2))::BIGINT AS r, ('0x' || substring(color, 4, 2))::BIGINT AS g, ('0x' || substring(color, 6, 2))::BIGINT AS b FROM c""")
def hex_colors(t: Tables) -> DataFrame:
    c = t.part.select("p_partkey", T.hex_color(F.lower(F.lpad(F.hex((F.col("p_partkey") * 7919) % 16777216), 6, "0"))).alias("color"))
    return c.select("p_partkey", "color", T.rgb(F.col("color")).alias("x")).select("p_partkey", "color", "x.*")


@query("""SELECT event_id, coalesce(try_cast(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE), 0.0) AS k, coalesce(try_cast(event_type AS DOUBLE), -1.0) AS d FROM events""")
def safe_cast(t: Tables) -> DataFrame:
    return t.events.select("event_id", T.to_double(F.regexp_extract("props", "([0-9]+)", 1)).alias("k"), T.to_double(F.col("event_type"), -1.0).alias("d"))


@query("""SELECT p_partkey, array_to_string(list_sort(list_distinct(list_filter(list_transform(string_split(p_name || ' 12 ' || p_name, ' '), lambda x: lower(x)), lambda x: NOT regexp_matches(x, '^[0-9]+$')))), ',') AS names FROM part""")
def section_list(t: Tables) -> DataFrame:
    low = F.transform(F.split(F.concat("p_name", F.lit(" 12 "), "p_name"), " "), lambda x: F.lower(x))
    return t.part.select("p_partkey", F.array_join(F.array_sort(F.array_distinct(F.filter(low, lambda x: ~x.rlike("^[0-9]+$")))), ",").alias("names"))


_PH = ", ".join(f"nullif(regexp_extract(text, '{p}'), '')" for p in T.PHONES)


@query(f"SELECT * FROM (SELECT doc_id, coalesce({_PH}) AS phone FROM documents) WHERE phone IS NOT NULL")
def phone_first(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", T.phone(F.col("text")).alias("phone")).where("phone is not null")


@query(rf"""WITH e AS (SELECT doc_id, unnest(regexp_extract_all(text, '{T.EMAIL}')) AS e, generate_subscripts(regexp_extract_all(text, '{T.EMAIL}'), 1) AS p FROM documents)
  SELECT doc_id, e AS email FROM e QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY (instr(e, '@') > 5)::INT DESC, length(e) DESC, p) = 1""")
def email_best(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", T.best_email(F.col("text")).alias("email")).where("email is not null")


@query(r"""WITH u AS (SELECT page_id, url, lower(regexp_extract(url, '^https?://([^/?#:]+)', 1)) AS host FROM pages)
  SELECT page_id, host, regexp_extract(url, '^https?://[^/?#]+(/[^?#]*)', 1) AS path, regexp_extract(host, '\.([a-z]+)$', 1) AS tld FROM u""")
def url_parts(t: Tables) -> DataFrame:
    u = F.col("url")
    return t.pages.select("page_id", T.url_host(u).alias("host"), T.url_path(u).alias("path"), T.url_tld(u).alias("tld"))


@query(f"""WITH {LINE} SELECT doc_id, {squash('line')} AS name FROM line WHERE ln <= 16 AND len({words('line')}) BETWEEN 2 AND 5 AND NOT regexp_matches(line, '[0-9]{{4}}')
  AND len(list_filter({words('line')}, lambda w: regexp_matches(w, '^[A-Z]'))) * 2 >= len({words('line')}) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY ln) = 1""")
def name_line(t: Tables) -> DataFrame:
    w = T.words(F.col("line"))
    capital = F.filter(w, lambda x: x.rlike("^[A-Z]"))
    like = lines(t.documents).where((F.col("ln") <= 16) & F.size(w).between(2, 5) & ~F.col("line").rlike("[0-9]{4}") & (F.size(capital) * 2 >= F.size(w)))
    return like.groupBy("doc_id").agg(F.min_by(T.squash(F.col("line")), "ln").alias("name"))


@query(rf"WITH {LINE} SELECT doc_id, regexp_extract(line, '([A-Z][a-z]+, [A-Z][a-z]+)', 1) AS place FROM line WHERE regexp_matches(line, '[A-Z][a-z]+, [A-Z][a-z]+') QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY ln) = 1")
def location_first(t: Tables) -> DataFrame:
    p = "([A-Z][a-z]+, [A-Z][a-z]+)"
    return lines(t.documents).where(F.col("line").rlike(p)).groupBy("doc_id").agg(F.min_by(F.regexp_extract("line", p, 1), "ln").alias("place"))


@query(r"""WITH p AS (SELECT p_partkey, list_filter(list_transform(regexp_extract_all(p_name || ' (a, b), ' || p_type || '; ' || p_brand, '(?:\([^)]*\)|[^(),;|•*])+'), lambda x: trim(x)), lambda x: x <> '') AS x FROM part)
  SELECT p_partkey, unnest(range(0, len(x)))::INTEGER AS pos, unnest(x) AS item FROM p""")
def paren_split(t: Tables) -> DataFrame:
    """Part names with a parenthesized group, split outside it (a fold: order-dependent)."""
    made = F.concat("p_name", F.lit(" (a, b), "), "p_type", F.lit("; "), "p_brand")
    return t.part.select("p_partkey", F.posexplode(T.split_outside_parens(made)).alias("pos", "item"))


_SYN = {"widget": "Widget Unit", "ring": "O-Ring", "bolt": "Hex Bolt", "gear": "Spur Gear"}


@query("SELECT p_partkey, word, CASE lower(word) WHEN 'widget' THEN 'Widget Unit' WHEN 'ring' THEN 'O-Ring' WHEN 'bolt' THEN 'Hex Bolt' WHEN 'gear' THEN 'Spur Gear' ELSE word END AS canonical FROM (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS word FROM part)")
def lookup_normalize(t: Tables) -> DataFrame:
    w = t.part.select("p_partkey", F.explode(F.split("p_name", " ")).alias("word"))
    return w.withColumn("canonical", T.lookup(F.col("word"), _SYN))


@query()
def space_repair(t: Tables) -> DataFrame:
    """Lost spaces put back in all documents (segmentation by a lexicon is not SQL; tests hold it against a plain segmenter)."""
    fixed = spacing.repair_spaces(F.col("text"))
    return t.documents.select("doc_id", fixed.alias("text"), (fixed != F.col("text")).alias("changed"))


#: Terms of the documents themselves, beside the glossary.
_RIGHTS = {"apache license": "Apache-License", "all rights": "All Rights"}


def _one_by_one(c: str, terms: dict[str, str]) -> str:
    """SQL of ordered replacements, the longest term first."""
    for old in sorted(terms, key=lambda x: (-len(x), x)):
        c = f"regexp_replace({c}, '(?i)\\b{re.escape(old)}\\b', '{terms[old]}', 'g')"
    return c


@query(f"SELECT doc_id, {_one_by_one('text', glossary.TERMS | _RIGHTS)} AS text FROM documents")
def glossary_restore(t: Tables) -> DataFrame:
    """All terms of the glossary, and two of the documents' own, in one pass over each text."""
    return t.documents.select("doc_id", glossary.rewrite_terms(F.col("text"), glossary.TERMS | _RIGHTS).alias("text"))


@query(r"""WITH s AS (SELECT doc_id, unnest(list_filter(list_transform(regexp_extract_all(regexp_replace(text, '\s+', ' ', 'g'), '[^.!?]+[.!?]*'), lambda x: trim(x)), lambda x: x <> '')) AS sentence,
  generate_subscripts(list_filter(list_transform(regexp_extract_all(regexp_replace(text, '\s+', ' ', 'g'), '[^.!?]+[.!?]*'), lambda x: trim(x)), lambda x: x <> ''), 1)::BIGINT AS pos FROM documents)
  SELECT doc_id, pos, sentence FROM s WHERE length(sentence) >= 12""")
def sentence_items(t: Tables) -> DataFrame:
    s = t.documents.select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("pos", "sentence"))
    return s.withColumn("pos", _long(F.col("pos") + 1)).where("length(sentence) >= 12")


@query(r"""WITH o AS (SELECT o_orderkey, o_orderpriority || ' order ' || strftime(o_orderdate, '%Y') AS s FROM orders)
  SELECT o_orderkey, trim(CASE WHEN regexp_extract(s, '((?:19|20)[0-9]{2})[\s]*$', 1) <> '' THEN regexp_replace(s, '((?:19|20)[0-9]{2})[\s]*$', '') ELSE s END) AS left_part, regexp_extract(s, '((?:19|20)[0-9]{2})[\s]*$', 1) AS right_part FROM o""")
def trailing_split(t: Tables) -> DataFrame:
    o = t.orders.select("o_orderkey", F.concat("o_orderpriority", F.lit(" order "), F.date_format("o_orderdate", "yyyy")).alias("s"))
    return o.select("o_orderkey", T.split_trailing(F.col("s"), T.YEAR).alias("x")).select("o_orderkey", F.col("x.left").alias("left_part"), F.col("x.right").alias("right_part"))


@query("SELECT o_custkey, strftime(min(o_orderdate), '%b %Y') || ' - ' || strftime(max(o_orderdate), '%b %Y') AS span FROM orders GROUP BY o_custkey")
def date_ranges(t: Tables) -> DataFrame:
    return t.orders.groupBy("o_custkey").agg(F.min("o_orderdate").alias("a"), F.max("o_orderdate").alias("b")).select("o_custkey", T.month_range(F.col("a"), F.col("b")).alias("span"))


@query("SELECT event_id, try_cast(json_extract_string(props, '$.k') AS BIGINT) AS k, json_valid(props) AS ok FROM events")
def json_props(t: Tables) -> DataFrame:
    j = T.json_object(F.col("props"))
    k = F.get_json_object(j, "$.k").try_cast("long")
    return t.events.select("event_id", k.alias("k"), F.expr("try_parse_json(props) is not null").alias("ok"))


_REPLY = r"""'{"id": ' || doc_id || ', "tags": ["a{", "b["], "text": "' || translate(text, chr(34) || chr(92) || chr(10), '   ') || '"}'"""


@query(rf"""WITH r AS (SELECT doc_id, {_REPLY} AS r FROM documents), c AS (SELECT doc_id, trim(left(r, greatest(0, length(r) - (doc_id % 5) * 9)::BIGINT)) AS t FROM r), b AS (SELECT *, regexp_replace(t, '(?s)"(?:[^"\\]|\\.)*(?:"|\\?$)', '', 'g') AS bare FROM c)
  SELECT doc_id, length(t)::BIGINT AS n, length(t) < 40 OR length(replace(bare, '{{', '')) < length(replace(bare, '}}', '')) OR length(replace(bare, '[', '')) < length(replace(bare, ']', '')) OR regexp_matches(t, '[\p{{L}}\p{{N}}\\]$') AS cut_off FROM b""")
def cut_off_replies(t: Tables) -> DataFrame:
    """Replies made of documents, four of five cut short by some characters, and which of them show it."""
    safe = F.translate("text", '"\\\n', "   ")
    reply = F.concat(F.lit('{"id": '), F.col("doc_id").cast("string"), F.lit(', "tags": ["a{", "b["], "text": "'), safe, F.lit('"}'))
    cut = F.trim(F.left(reply, F.greatest(F.lit(0), F.length(reply) - (F.col("doc_id") % 5) * 9).cast("int")))
    return t.documents.select("doc_id", cut.alias("t")).select("doc_id", _long(F.length("t")).alias("n"), T.looks_cut_off(F.col("t")).alias("cut_off"))


_TOLD = "CASE l_linenumber % 2 WHEN 1 THEN 'Built part ' || l_partkey || ' in lot ' || l_linenumber || ' with care.' ELSE 'The lot held ' || l_partkey || ' pieces.' END"


@query(f"""WITH s AS (SELECT l_orderkey, string_agg({_TOLD}, ' ' ORDER BY l_linenumber, l_partkey, l_suppkey) AS text, list({{'n': l_linenumber, 's': {_TOLD}}} ORDER BY l_linenumber, l_partkey, l_suppkey) AS r FROM lineitem GROUP BY l_orderkey),
  e AS (SELECT l_orderkey, unnest(r) AS x, generate_subscripts(r, 1) AS p, length(text) AS n, len(r) AS k FROM s),
  g AS (SELECT l_orderkey, x.s AS s, p, CASE WHEN n >= 180 AND k >= 2 THEN sum((x.n % 2 = 1 AND p > 1)::INT) OVER (PARTITION BY l_orderkey ORDER BY p) ELSE 0 END AS g FROM e),
  i AS (SELECT l_orderkey, g, string_agg(s, ' ' ORDER BY p) AS item FROM g GROUP BY l_orderkey, g), f AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, {key('item')} ORDER BY g) AS again FROM i)
  SELECT l_orderkey AS o_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY g) AS pos, item FROM f WHERE again = 1 QUALIFY pos <= 20""")
def verb_items(t: Tables) -> DataFrame:
    """Orders told as paragraphs, one sentence a line item, cut into items before verbs."""
    part, n = F.col("l_partkey").cast("string"), F.col("l_linenumber")
    told = F.when(n % 2 == 1, F.concat(F.lit("Built part "), part, F.lit(" in lot "), n.cast("string"), F.lit(" with care."))).otherwise(F.concat(F.lit("The lot held "), part, F.lit(" pieces.")))
    text = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", told.alias("s")))).alias("r"))
    got = text.select("o_orderkey", F.posexplode(items.verb_items(F.array_join("r.s", " "))).alias("pos", "item"))
    return got.select("o_orderkey", _long(F.col("pos") + 1).alias("pos"), "item")


_PARTS = r"regexp_replace({0}, '([.!?])\s+([A-Z(])', '\1' || chr(1) || '\2', 'g')"
_EDGE = "' ' || chr(9) || '•-–—[]' || chr(39) || chr(34)"


@query(rf"""WITH d AS (SELECT doc_id, trim(text) AS t FROM documents WHERE text IS NOT NULL),
  p AS (SELECT doc_id, CASE WHEN regexp_matches(t, '[•\n\r]|(?:^|\s)[-–—]\s+') THEN string_split(regexp_replace(t, '(?:\r?\n)+|•+|(?:^|\s)[-–—]\s+', chr(1), 'g'), chr(1))
    WHEN length(t) < 160 AND length(t) - length(replace(t, '.', '')) <= 1 THEN [t] ELSE string_split({_PARTS.format('t')}, chr(1)) END AS parts FROM d),
  e AS (SELECT doc_id, unnest(parts) AS x, generate_subscripts(parts, 1) AS i FROM p), c AS (SELECT doc_id, i, regexp_replace(trim(x, {_EDGE}), '\s+', ' ', 'g') AS x FROM e),
  w AS (SELECT * FROM c WHERE length(x) >= 12 AND NOT (starts_with(x, '[') OR ends_with(x, ']') OR (length(x) - length(replace(x, chr(39), '')) >= 2 AND length(x) < 40)) QUALIFY row_number() OVER (PARTITION BY doc_id, lower(x) ORDER BY i) = 1),
  g AS (SELECT doc_id, list(x ORDER BY i) AS items, count(*) >= 8 AND sum(length(x)) < 60 * count(*) AS tiny, string_agg(x, ' ' ORDER BY i) AS joined FROM w GROUP BY doc_id),
  a AS (SELECT doc_id, CASE WHEN tiny THEN list_filter(list_transform(string_split({_PARTS.format('joined')}, chr(1)), lambda y: trim(y)), lambda y: length(y) >= 12) ELSE items END AS items, joined FROM g)
  SELECT doc_id, generate_subscripts(items, 1)::BIGINT AS pos, unnest(items) AS item FROM (SELECT doc_id, CASE WHEN len(items) = 0 THEN [joined] ELSE items END AS items FROM a)""")
def summary_items(t: Tables) -> DataFrame:
    """All documents as summaries: their lines, dashes or sentences as items."""
    got = t.documents.where("text is not null").select("doc_id", F.posexplode(items.summary_items(F.col("text"))).alias("pos", "item"))
    return got.select("doc_id", _long(F.col("pos") + 1).alias("pos"), "item")


@query("SELECT event_type, count(*)::BIGINT AS n, contains(event_type, 'err') OR contains(event_type, 'fail') AS is_error FROM events GROUP BY event_type")
def error_classes(t: Tables) -> DataFrame:
    c = F.col("event_type")
    return t.events.groupBy("event_type").agg(F.count(F.lit(1)).alias("n")).withColumn("is_error", c.contains("err") | c.contains("fail"))


@query(r"""WITH h AS (SELECT page_id, unnest(regexp_extract_all(html, '<h[1-3]>([^<]*)</h[1-3]>', 1)) AS h, generate_subscripts(regexp_extract_all(html, '<h[1-3]>([^<]*)</h[1-3]>', 1), 1) AS p FROM pages)
  SELECT page_id, string_agg(h, ' | ' ORDER BY p) FILTER (p <= 10) AS headings FROM h GROUP BY page_id""")
def page_headings(t: Tables) -> DataFrame:
    h = F.regexp_extract_all("html", F.lit("<h[1-3]>([^<]*)</h[1-3]>"), F.lit(1))
    return t.pages.where(F.size(h) > 0).select("page_id", F.array_join(F.slice(h, 1, 10), " | ").alias("headings"))


@query("""WITH v AS (SELECT * FROM (VALUES ('license'),('version'),('rights'),('apache'),('warranty')) x(term))
  SELECT d.doc_id, string_agg(v.term, ',' ORDER BY v.term) AS terms FROM documents d JOIN v ON contains(lower(d.text), v.term) GROUP BY d.doc_id""")
def vocabulary_hits(t: Tables) -> DataFrame:
    vocab = F.array(*[F.lit(x) for x in sorted(("license", "version", "rights", "apache", "warranty"))])
    return t.documents.select("doc_id", F.array_join(F.filter(vocab, lambda v: F.contains(F.lower("text"), v)), ",").alias("terms")).where("terms <> ''")
