"""Exact and fuzzy joins between names, records and texts.

Fuzzy conditions meet on a token or prefix first, so the shuffle is an equi-join and the
condition is checked on what meets; no side is compared with all of the other.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import text as T

#: Company suffixes that do not count in a name (fixed values).
SUFFIXES = ("inc", "llc", "ltd", "limited", "corp", "corporation", "co", "company", "gmbh", "pvt", "private")


def entity_tokens(name: Column) -> Column:
    """Lower-cased words of a name longer than two letters, without company suffixes."""
    found = F.split(F.trim(F.regexp_replace(F.lower(name), "[^a-z0-9]+", " ")), " ")
    return F.array_distinct(F.filter(found, lambda w: (F.length(w) > 2) & ~w.isin(*SUFFIXES)))


def entity_key(name: Column) -> Column:
    """All lower-cased words of a name but company suffixes, joined by spaces."""
    found = F.split(F.trim(F.regexp_replace(F.lower(name), "[^a-z0-9]+", " ")), " ")
    return F.array_join(F.filter(found, lambda w: ~w.isin(*SUFFIXES)), " ")


def _spaced(c: str) -> Column:
    return F.concat(F.lit(" "), F.col(c), F.lit(" "))


def entity_pairs(left: DataFrame, right: DataFrame, ratio: float = 0.6) -> DataFrame:
    """(l, r, share) of the distinct names left(l) and right(r): share is 1 for equal keys or keys of which one contains the other as
    words; other names match that share at least ``ratio`` of the smaller one's tokens, and share says how much.

    Tokens meet by a prefix filter: the smaller name's rarest tokens, so many that one must be shared. Keys meet by the
    first word of the one that is contained.
    """
    a = left.select("l", entity_tokens(F.col("l")).alias("ta"), entity_key(F.col("l")).alias("ka")).distinct()
    b = right.select("r", entity_tokens(F.col("r")).alias("tb"), entity_key(F.col("r")).alias("kb")).distinct()
    both = a.select(F.explode("ta").alias("t")).unionByName(b.select(F.explode("tb").alias("t"))).groupBy("t").agg(F.count(F.lit(1)).alias("df"))

    def prefixes(names: DataFrame, name: str, tokens: str) -> DataFrame:
        ranked = names.select(name, F.explode(tokens).alias("t")).join(both, "t").groupBy(name).agg(F.array_sort(F.collect_list(F.struct("df", "t"))).alias("x"))
        n = F.size("x")
        return ranked.select(name, F.explode(F.slice(F.col("x.t"), F.lit(1), (n - F.ceil(ratio * n - 1e-9) + 1).cast("int"))).alias("t"))

    every = prefixes(a, "l", "ta").join(b.select("r", F.explode("tb").alias("t")), "t").select("l", "r")
    every = every.unionByName(a.select("l", F.explode("ta").alias("t")).join(prefixes(b, "r", "tb"), "t").select("l", "r"))
    first = lambda c: F.split(c, " ")[0].alias("w")
    words = lambda c: F.explode(F.array_distinct(F.split(c, " "))).alias("w")
    named_a, named_b = a.where("ka <> ''"), b.where("kb <> ''")
    every = every.unionByName(named_a.select("l", first("ka")).join(named_b.select("r", words("kb")), "w").select("l", "r"))
    every = every.unionByName(named_a.select("l", words("ka")).join(named_b.select("r", first("kb")), "w").select("l", "r"))
    whole = (F.col("ka") != "") & (F.col("kb") != "") & (_spaced("ka").contains(_spaced("kb")) | _spaced("kb").contains(_spaced("ka")))
    common = F.size(F.array_intersect("ta", "tb"))
    share = F.when(whole, 1.0).otherwise(common / F.least(F.size("ta"), F.size("tb")))
    return every.distinct().join(a, "l").join(b, "r").select("l", "r", share.alias("share"), common.alias("_common")).where((F.col("share") >= ratio) & ((F.col("_common") > 0) | (F.col("share") == 1))).drop("_common")


def backfill(found: DataFrame, source: DataFrame, key: str) -> DataFrame:
    """found, then the source rows whose key it lacks; ``origin`` says which."""
    missing = source.join(found.select(key).distinct(), key, "left_anti")
    return found.withColumn("origin", F.lit("found")).unionByName(missing.withColumn("origin", F.lit("backfilled")), allowMissingColumns=True)


def semi_or_all(rows: DataFrame, source: DataFrame, key: str) -> DataFrame:
    """Rows whose key the source has; all rows if none survives (one aggregate decides, inside the plan)."""
    kept = rows.join(source.select(key).distinct(), key, "left_semi")
    none = kept.agg(F.count(F.lit(1)).alias("_n"))
    rest = rows.join(F.broadcast(none), F.col("_n") == 0).drop("_n")
    return kept.unionByName(rest)


def pair_in_order(left: DataFrame, right: DataFrame, key: str, left_order: Sequence[str], right_order: Sequence[str]) -> DataFrame:
    """One-to-one left join: the nth row of a key on the left takes the nth on the right."""
    number = lambda order: F.row_number().over(W.partitionBy(key).orderBy(*order)).cast("long")
    return left.withColumn("nth", number(left_order)).join(right.withColumn("nth", number(right_order)), [key, "nth"], "left")


def last_wins(rows: DataFrame, key: str, position: str) -> DataFrame:
    """The last row of each key, as a lookup table."""
    cols = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*cols), position).alias("r")).select(key, "r.*")


def first_rule(df: DataFrame, value: Column, rules: Sequence[tuple[str, str]], name: str, default: str | None = None) -> DataFrame:
    """Adds the category of the first rule (pattern, category) that the value matches."""
    chain = F.lit(default)
    for pattern, category in reversed(rules):
        chain = F.when(value.rlike(pattern), category).otherwise(chain)
    return df.withColumn(name, chain)


def content_tokens(c: Column, least: int = 4, stop: Sequence[str] = ("with", "that", "this", "from", "have", "were")) -> Column:
    found = F.regexp_extract_all(F.lower(c), F.lit(f"([a-z0-9+]{{{least},}})"), F.lit(1))
    return F.array_distinct(F.filter(found, lambda w: ~w.isin(*stop)))


def grounded_pairs(claims: DataFrame, facts: DataFrame, share: float = 0.45, least: int = 3) -> DataFrame:
    """(claim, fact, hits, n) of claims(claim, text) and facts(fact, text): the fact has at least max(least, floor(share n))
    of the claim's n content tokens. The tokens meet in an equi-join; counts are combined before the shuffle."""
    a = claims.select("claim", content_tokens(F.col("text")).alias("t")).withColumn("n", F.size("t").cast("long")).select("claim", "n", F.explode("t").alias("token"))
    b = facts.select("fact", F.explode(content_tokens(F.col("text"))).alias("token"))
    met = a.join(b, "token").groupBy("claim", "n", "fact").agg(F.count(F.lit(1)).alias("hits"))
    return met.where(F.col("hits") >= F.greatest(F.lit(least), F.floor(T.part_of(share, F.col("n"))))).select("claim", "fact", "hits", "n")


def prefix_traced(rows: DataFrame, source: DataFrame, text: str, length: int = 60) -> DataFrame:
    """Rows whose normalized prefix a source row has."""
    key = F.substring(T.alnum_key(F.col(text)), 1, length)
    keys = source.select(key.alias("_k")).where("_k <> ''").distinct()
    return rows.withColumn("_k", key).join(keys, "_k", "left_semi").drop("_k")


def first_contained(rows: DataFrame, names: DataFrame, text: str, key: str) -> DataFrame:
    """Left join on containment: the first name (by rank) of names(rank, name) that the text contains as words, or that contains
    the text. Rows are known by their ``key``.

    The first word of the one that is contained meets the other's words; the whole is then checked.
    """
    there, here = F.col(text), F.col("name")
    spaced = lambda c: F.concat(F.lit(" "), F.lower(c), F.lit(" "))
    each = lambda c: F.explode(F.array_distinct(T.words(F.lower(c))))
    first = lambda c: F.get(T.words(F.lower(c)), F.lit(0))
    some = rows.select(key, text)
    met = some.withColumn("_w", each(there)).join(names.withColumn("_w", first(here)), "_w").where(spaced(there).contains(spaced(here)))
    back = some.withColumn("_w", first(there)).join(names.withColumn("_w", each(here)), "_w").where(spaced(here).contains(spaced(there)))
    best = met.select(key, "rank", "name").unionByName(back.select(key, "rank", "name")).groupBy(key).agg(F.min(F.struct("rank", "name")).alias("b"))
    return rows.join(best, key, "left").select(*rows.columns, F.col("b.name").alias("matched"))


def contained_in_source(rows: DataFrame, source: DataFrame, whole: str, part: str, prefix: int = 12, grams: int = 5) -> DataFrame:
    """Rows that the source grounds, or all of the source if none is: the row's ``whole`` key, or the first ``prefix`` characters of its
    ``part`` key, stands in a source row's joined keys (or they are equal). Blank keys ground nothing.

    A wanted string meets the keys by its first ``grams`` characters, which a key that contains it has as a gram.
    """
    norm = lambda c: T.alnum_key(F.col(c))
    keys = source.select(F.concat(norm(whole), norm(part)).alias("k")).distinct()
    gram = F.explode(F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), F.lit(grams)), lambda n: F.transform(
        F.sequence(F.lit(1), F.greatest(F.lit(1), F.length("k") - n + 1)), lambda i: F.substring(F.col("k"), i, n))))))
    wanted = rows.select(whole, part, F.explode(F.array(norm(whole), F.substring(norm(part), 1, prefix))).alias("_s")).where("_s <> ''")
    hit = wanted.withColumn("_g", F.substring("_s", 1, grams)).join(keys.withColumn("_g", gram), "_g").where(F.col("k").contains(F.col("_s"))).select(whole, part).distinct()
    kept = rows.join(hit, (rows[whole].eqNullSafe(hit[whole])) & (rows[part].eqNullSafe(hit[part])), "left_semi")
    none = kept.agg(F.count(F.lit(1)).alias("_n"))
    return kept.unionByName(source.select(*rows.columns).join(F.broadcast(none), F.col("_n") == 0).drop("_n"))


def lost_details(source: DataFrame, output: DataFrame, key: str, least: int = 4, share: float = 0.6, floor: int = 3) -> DataFrame:
    """Keys with at least ``least`` source details of which the output has fewer than max(floor, int(share × source))."""
    joined = source.groupBy(key).agg(F.count(F.lit(1)).alias("n_source")).join(output.groupBy(key).agg(F.count(F.lit(1)).alias("n_output")), key)
    return joined.where((F.col("n_source") >= least) & (F.col("n_output") < F.greatest(F.lit(floor), F.floor(T.part_of(share, F.col("n_source"))))))
