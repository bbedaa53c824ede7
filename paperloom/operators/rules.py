"""Validation rules: findings, roll-ups, scores, and the bounded repair loop."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """A condition that a row breaks, with what to say about it."""

    rule_id: str
    section: str
    severity: str  # critical or warn
    issue: str
    broken: Column


def findings(df: DataFrame, rules: Sequence[Rule], key: str = "doc_id") -> DataFrame:
    """key, rule_id, section, severity, issue: a row per broken rule, from one pass over the data."""
    each = [
        F.when(r.broken, F.struct(*[F.lit(v).alias(n) for n, v in (("rule_id", r.rule_id), ("section", r.section), ("severity", r.severity), ("issue", r.issue))]))
        for r in rules
    ]
    return df.select(key, F.explode(F.array_compact(F.array(*each))).alias("f")).select(key, "f.*")


def quality_score(found: DataFrame, all_keys: DataFrame, key: str = "doc_id") -> DataFrame:
    """100 less 12 per critical and 2 per warning, at least 0; 100 for keys without findings."""
    got = found.groupBy(key).agg(F.count_if(F.col("severity") == "critical").alias("n_critical"), F.count_if(F.col("severity") == "warn").alias("n_warn"))
    n = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return all_keys.select(key).join(got, key, "left").select(
        key, n(F.col("n_critical")).alias("n_critical"), n(F.col("n_warn")).alias("n_warn")
    ).withColumn("score", F.greatest(F.lit(0).cast("long"), 100 - 12 * F.col("n_critical") - 2 * F.col("n_warn")))


def roll_up(found: DataFrame, *keys: str) -> DataFrame:
    """Findings and distinct documents per keys."""
    return found.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("doc_id").alias("n_docs"))


def repair(
    rows: DataFrame, rules: Sequence[Rule], fix: Callable[[DataFrame], DataFrame], rounds: int = 2, threshold: int = 85,
    written: Callable[[DataFrame], DataFrame] = lambda df: df,
) -> DataFrame:
    """doc_id, text, score, round: bounded rounds of critique and repair.

    A document whose score reaches the threshold with no critical finding is done; others are fixed and judged again. The
    best draft stays (the earlier of equals). ``written`` cuts lineage between rounds (a checkpoint).
    """
    best = None
    now = rows.select("doc_id", "text")
    for k in range(rounds + 1):
        judged = quality_score(findings(now, rules), now).join(now, "doc_id").withColumn("round", F.lit(k).cast("long"))
        judged = written(judged)
        best = judged if best is None else best.unionByName(judged)
        if k < rounds:
            now = fix(judged.where((F.col("score") < threshold) | (F.col("n_critical") > 0)).select("doc_id", "text"))
    order = F.struct("score", (-F.col("round")).alias("r"))
    return best.groupBy("doc_id").agg(F.max_by(F.struct("text", "score", "round"), order).alias("b")).select("doc_id", "b.*")


def in_expected_order(found: DataFrame, expected: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, ordered, missing of found(key, pos, section) against expected(section, rank, required)."""
    known = found.join(F.broadcast(expected), "section")
    got = known.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", "rank"))).alias("r"), F.collect_set("section").alias("have"))
    ranks = F.col("r.rank")
    required = expected.where("required").agg(F.array_sort(F.collect_list("section")).alias("need"))
    return got.join(F.broadcast(required)).select(
        key, (ranks == F.array_sort(ranks)).alias("ordered"), F.array_join(F.array_sort(F.array_except("need", "have")), ",").alias("missing"))


#: Sizes that a style may have (fixed values).
SIZES = (("font_size_body", 8, 16), ("font_size_header", 8, 24), ("font_size_name", 8, 36))


def format_findings(docs: DataFrame, sections: DataFrame, expected: DataFrame) -> DataFrame:
    """doc_id, section, severity, issue of composed documents against a format.

    docs(doc_id, name, contacts array, font_family, font_size_body, font_size_header, font_size_name), sections(doc_id, pos, section, title), and the
    format's expected(section, rank, label, required), which is small. Critical: expected sections in another order, a required one missing, no name. Warned: titles unlike
    their labels (but for case, marks and a closing colon), sizes out of range, no font, contact details. One aggregate by document; each rule is an array of
    findings.
    """
    bare = lambda c: F.regexp_replace(F.lower(F.regexp_replace(F.trim(c), r"[:\s]+$", "")), "[^a-z0-9]+", "")
    plain = lambda c: F.regexp_replace(F.trim(c), r"[:\s]+$", "")
    say = lambda section, severity, issue: F.struct(section.alias("section"), F.lit(severity).alias("severity"), issue.alias("issue"))
    none = F.array().cast("array<struct<section:string,severity:string,issue:string>>")
    when = lambda c, section, severity, issue: F.when(c, F.array(say(F.lit(section), severity, issue))).otherwise(none)
    placed = sections.join(F.broadcast(expected.select("section", "rank", "label")), "section", "left")
    listed = placed.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "section", "title", "rank", "label"))).alias("s"))
    needs = expected.where("required").agg(F.array_sort(F.collect_list(F.struct("rank", "section"))).alias("needs"))
    rows = docs.join(listed, "doc_id", "left").join(F.broadcast(needs)).withColumn("s", F.coalesce("s", F.array().cast(listed.schema["s"].dataType)))
    known = F.filter("s", lambda x: x["rank"].isNotNull())
    actual = F.transform(known, lambda x: x["section"])
    ordered = F.transform(F.array_sort(F.array_distinct(F.transform(known, lambda x: F.struct(x["rank"].alias("rank"), x["section"].alias("section"))))), lambda x: x["section"])
    have = F.transform("s", lambda x: x["section"])
    missing = F.transform(F.filter(F.transform("needs", lambda x: x["section"]), lambda x: ~F.array_contains("have", x)), lambda x: say(x, "critical", F.concat(F.lit("Required section '"), x, F.lit("' is missing"))))
    unlike = F.transform(
        F.filter("s", lambda x: (bare(x["title"]) != "") & (bare(x["label"]) != "") & (bare(x["title"]) != bare(x["label"]))),
        lambda x: say(x["section"], "warn", F.concat(F.lit("Section label '"), plain(x["title"]), F.lit("' differs from format '"), plain(x["label"]), F.lit("'"))))
    sizes = [when(F.coalesce(F.col(c), F.lit(0.0)) != 0.0, "styling", "warn", F.concat(F.lit(f"{c}="), F.col(c).cast("string"), F.lit(f" outside sane range {lo}-{hi}"))) for c, lo, hi in SIZES]
    sizes = [F.when((F.col(c) < lo) | (F.col(c) > hi), x).otherwise(none) for x, (c, lo, hi) in zip(sizes, SIZES, strict=True)]
    name = F.trim(F.coalesce("name", F.lit("")))
    found = F.concat(
        when(F.array_join("actual", ",") != F.array_join("ordered", ","), "structure", "critical", F.substring(F.concat(F.lit("Section order mismatch. expected="), F.array_join("ordered", ","), F.lit(" actual="), F.array_join("actual", ",")), 1, 200)),
        missing, unlike, *sizes,
        when(F.trim(F.coalesce("font_family", F.lit(""))) == "", "styling", "warn", F.lit("font_family is missing")),
        when((name == "") | F.lower(name).isin("candidate", "unknown"), "header", "critical", F.lit("Name is missing")),
        when(F.exists(F.coalesce("contacts", F.array().cast("array<string>")), lambda x: F.trim(x) != ""), "header", "warn", F.lit("Contact details are in the header")))
    staged = rows.withColumns({"actual": actual, "ordered": ordered, "have": have})
    return staged.select("doc_id", F.explode(found).alias("f")).select("doc_id", "f.*")
