"""Greedy near-duplicate choice: the relation, its fold within groups, and the same choice over a whole table by rounds.

Items are (id, tokens, signals, themes, size, score). Two are near by Jaccard of tokens 0.58; or 0.42 with five common
tokens; or 0.28 with two common signals; or 0.18 with equal signals, two at least; or with a common theme. Items
without tokens are near none. In order, an item meets the kept item in the first slot that is near: it takes the slot
if it scores higher, or is over 20 characters longer and scores at most 0.5 less, and goes otherwise; near none, it opens a slot.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import dropped, written
from .dedupe import least_reachable, shared_token_pairs
from .ranking import SIGNALS

#: Tokens that say nothing of a text, and the words of themes (fixed values).
STOP = (
    "with", "from", "using", "that", "this", "have", "been", "were", "their",
    "team", "project", "system", "application", "applications", "services",
    "based", "across", "including", "through", "while", "into", "over",
    "and", "the", "for", "supporting", "utilizing", "leveraging", "platforms",
    "standards", "compliant", "modules", "frontend", "backend", "enterprise",
)
ACCESS = ("wcag", "accessibility", "508", "aria", "section")
STACKS = ("angular", "react", "vue", "html", "html5", "typescript")
INTEGRATION = ("mulesoft", "anypoint", "raml", "dataweave", "weave")
SUBTHEMES = {"test": ("munit", "testing", "validation"), "policy": ("policy", "oauth", "manager", "rate"), "integration": ("raml", "dataweave", "weave", "anypoint", "integration")}
#: Jaccard alone; with common tokens; with common signals; with equal signals.
ALONE, SHARED, SIGNALLED, EQUAL = 0.58, 0.42, 0.28, 0.18
#: Slack of thresholds in double precision.
_EPS = 1e-9


def overlap_tokens(text: Column) -> Column:
    """Distinct tokens of three characters or more, without marks at their ends and what follows a dot, minus STOP."""
    raw = F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9][a-z0-9+.#-]{2,})"), F.lit(1))
    stems = F.transform(raw, lambda t: F.split(F.btrim(t, F.lit(".-+")), r"\.")[0])
    return F.array_distinct(F.filter(stems, lambda t: (F.length(t) >= 3) & ~t.isin(*STOP)))


def signal_words(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}_]+"), lambda w: w.isin(*SIGNALS)))


def theme_keys(tokens: Column) -> Column:
    """Keys that items of one theme share: accessibility of a front-end stack, or a kind of integration work."""
    has = lambda words: F.arrays_overlap(tokens, F.array(*[F.lit(w) for w in words]))
    stacks = F.transform(F.array_intersect(tokens, F.array(*[F.lit(w) for w in STACKS])), lambda s: F.concat(F.lit("access:"), s))
    kind = F.when(F.lit(False), F.lit(""))
    for name, words in SUBTHEMES.items():
        kind = kind.when(has(words), F.lit(f"integration:{name}"))
    none = F.array().cast("array<string>")
    return F.concat(F.when(has(ACCESS), stacks).otherwise(none), F.when(has(INTEGRATION) & kind.isNotNull(), F.array(kind)).otherwise(none))


def featured(rows: DataFrame, text: Column, score: Column, *keep: Column | str) -> DataFrame:
    """The kept columns with tokens, signals, themes, size and score of a text; texts under 25 characters are left out."""
    got = rows.where(F.length(text) >= 25).select(*keep, overlap_tokens(text).alias("tokens"), signal_words(text).alias("signals"), F.length(text).cast("long").alias("size"), score.cast("double").alias("score"))
    return got.withColumn("themes", theme_keys(F.col("tokens")))


# ---------------------------------------------------------------- within groups


def near(a: dict, b: dict) -> bool:
    """The relation on two items with sets of tokens, signals and themes."""
    if not a["tokens"] or not b["tokens"]:
        return False
    common = len(a["tokens"] & b["tokens"])
    share = common / len(a["tokens"] | b["tokens"])
    both = a["signals"] & b["signals"]
    return bool(
        share >= ALONE or (common >= 5 and share >= SHARED) or (len(both) >= 2 and share >= SIGNALLED)
        or (len(both) >= 2 and a["signals"] == b["signals"] and share >= EQUAL) or a["themes"] & b["themes"])


def better(new: dict, old: dict) -> bool:
    return new["score"] > old["score"] or (new["size"] > old["size"] + 20 and new["score"] >= old["score"] - 0.5)


def collapse_groups(items: DataFrame, group: str) -> DataFrame:
    """group, pos, score of the items(group, pos, ...) that each group keeps.

    Groups (a document's or section's items) come sorted through the tasks; one group's kept items are held at a time, never its rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, kept = None, []
        for batch in batches:
            done = []
            for r in batch.to_pylist():
                if r["group"] != at:
                    done += kept
                    at, kept = r["group"], []
                item = {**r, **{k: frozenset(r[k]) for k in ("tokens", "signals", "themes")}}
                slot = next((i for i, k in enumerate(kept) if near(k, item)), None)
                if slot is None:
                    kept.append(item)
                elif better(item, kept[slot]):
                    kept[slot] = item
            yield out(done)
        yield out(kept)

    def out(found: list[dict]) -> pa.RecordBatch:
        return pa.record_batch([pa.array([k[c] for k in found], t) for c, t in (("group", kind), ("pos", pa.int64()), ("score", pa.float64()))], names=[group, "pos", "score"])

    kind = pa.int64() if items.schema[group].dataType.simpleString() == "bigint" else pa.string()
    rows = items.select(F.col(group).alias("group"), F.col("pos").cast("long").alias("pos"), "tokens", "signals", "themes", "size", "score")
    sorted_rows = rows.repartition("group").sortWithinPartitions("group", "pos")
    return sorted_rows.mapInArrow(run, f"{group} {items.schema[group].dataType.simpleString()}, pos long, score double")


# ---------------------------------------------------------------- over a table


def near_edges(items: DataFrame) -> DataFrame:
    """a, b, up of the near items a < b; up: b would take a's slot.

    Candidates share one of the rare tokens of a prefix for the lowest Jaccard that can still link them (0.42, or 0.18
    among items with two signals), or a theme. A theme links all its items with one another, so its links grow with their square.
    """
    sets = items.where(F.size("tokens") > 0)
    word = shared_token_pairs(sets.select("id", "tokens"), SHARED)
    found = word.where((F.col("common") >= ALONE * F.col("total") - _EPS) | (F.col("common") >= 5)).select("a", "b")
    side = lambda at: sets.select(F.col("id").alias(at), F.col("signals").alias(f"s{at}"))
    many = sets.where(F.size("signals") >= 2)
    tied = shared_token_pairs(many.select("id", "tokens"), EQUAL).join(side("a"), "a").join(side("b"), "b")
    both = F.size(F.array_intersect("sa", "sb"))
    equal = (both == F.size("sa")) & (both == F.size("sb"))
    found = found.unionByName(tied.where((both >= 2) & (equal | (F.col("common") >= SIGNALLED * F.col("total") - _EPS))).select("a", "b"))
    theme = sets.select("id", F.explode("themes").alias("theme"))
    met = theme.withColumnRenamed("id", "a").join(theme.withColumnRenamed("id", "b"), "theme").where("a < b").select("a", "b")
    worth = lambda at: items.select(F.col("id").alias(at), F.col("size").alias(f"n{at}"), F.col("score").alias(f"v{at}"))
    up = (F.col("vb") > F.col("va")) | ((F.col("nb") > F.col("na") + 20) & (F.col("vb") >= F.col("va") - 0.5))
    return found.unionByName(met).distinct().join(worth("a"), "a").join(worth("b"), "b").select("a", "b", up.alias("up"))


#: Links of a component that one task folds; larger ones are decided by rounds.
FOLDED = 1_000_000


def folded(links: DataFrame) -> DataFrame:
    """id, slot, kept of the items of links(part, a, b, up), each part in order of id. A part's links stream through a task; its items' slots are held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, item, met, slot, held = None, None, None, {}, set()

        def settle() -> None:
            slot[item] = met[0] if met else item
            if not met or met[2]:
                held.add(item)
                held.discard(met and met[1])

        def out() -> pa.RecordBatch:
            return pa.record_batch([pa.array(list(slot), pa.int64()), pa.array(list(slot.values()), pa.int64()), pa.array([i in held for i in slot], pa.bool_())], names=["id", "slot", "kept"])

        for batch in batches:
            for p, a, b, up in zip(*(batch.column(c).to_pylist() for c in ("part", "a", "b", "up")), strict=True):
                if b != item or p != part:
                    if item is not None:
                        settle()
                    if p != part:
                        if part is not None:
                            yield out()
                        part, slot, held = p, {}, set()
                    item, met = b, None
                if a not in slot:
                    slot[a] = a
                    held.add(a)
                if a in held and (met is None or slot[a] < met[0]):
                    met = slot[a], a, up
        if item is not None:
            settle()
            yield out()

    return links.select("part", "a", "b", "up").repartition("part").sortWithinPartitions("part", "b", "a").mapInArrow(run, "id long, slot long, kept boolean")


def choose(items: DataFrame) -> DataFrame:
    """id, slot, kept of all items: the slot that an item has met or opened, and whether it holds it in the end.

    Items that links do not join cannot touch one another: components of at most FOLDED links are folded in order of id, a component in a task.
    Larger ones take the lexicographically first choice by rounds over the near graph, with the same result as the fold.
    An item is decided when every earlier neighbour that may still hold a slot at its turn is known, or when a neighbour surely
    holds one (no undecided item before it could take it) and no undecided neighbour can come by an earlier one. Items that would not take
    their holder's slot do not wait for one another, so a group of n copies takes a few rounds, and others about as many as
    slots change holders. Every round is a join, aggregates and a reliable checkpoint; no row holds a group.

    Items whose features (tokens, signals, score, size) equal an earlier item's go with it: they are never better. Items without tokens
    hold their own slots. ids must be unique.
    """
    digest = F.when(F.size("tokens") > 0, F.md5(F.to_json(F.struct(F.array_sort("tokens").alias("t"), F.array_sort("signals").alias("s"), "score", "size")))).otherwise(F.concat(F.lit("#"), F.col("id").cast("string")))
    keyed = written(items.withColumn("same", digest))
    first = keyed.groupBy("same").agg(F.min("id").alias("id"))
    singles = written(keyed.join(first, ["same", "id"]).select("id", "tokens", "signals", "themes", "size", "score"))
    found = written(near_edges(singles))
    part = least_reachable(_ends(found), found, both=True).select(F.col("id").alias("b"), F.col("low").alias("part"))
    links = written(found.join(part, "b").select("part", "a", "b", "up"))
    large = written(links.groupBy("part").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > FOLDED).select("part"))
    settled = folded(links.join(large, "part", "left_anti"))
    if large.limit(1).count():
        settled = settled.unionByName(_by_rounds(links.join(large, "part", "left_semi").select("a", "b", "up")))
    chosen = first.join(settled, "id", "left").select("same", F.col("id").alias("first"), F.coalesce("slot", "id").alias("slot"), F.coalesce("kept", F.lit(True)).alias("kept"))
    return keyed.select("id", "same").join(chosen, "same").select("id", "slot", (F.col("kept") & (F.col("id") == F.col("first"))).alias("kept"))


def _ends(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("a").alias("id")).unionByName(edges.select(F.col("b").alias("id"))).distinct()


def _by_rounds(edges: DataFrame) -> DataFrame:
    """id, slot, kept of the items of edges(a, b, up), decided by rounds."""
    edges = written(edges)
    low = least_reachable(_ends(edges), edges)
    #: slot, until: of holders, and when another took the slot; low: no slot before it can come to the item
    none = F.lit(None).cast("long")
    nodes = written(low.select("id", F.lit(False).alias("done"), F.lit(False).alias("held"), none.alias("slot"), none.alias("until"), "low"))
    while nodes.where("not done").limit(1).count():
        y = nodes.select(*[F.col(c).alias({"id": "a"}.get(c, f"a_{c}")) for c in nodes.columns])
        open_ = edges.join(nodes.where("not done").select(F.col("id").alias("b")), "b")
        risk = open_.where("up").groupBy("a").agg(F.min("b").alias("risk"))
        seen = open_.join(y, "a").join(risk, "a", "left")
        live = seen.where("not a_done or (a_held and (a_until is null or a_until > b))")
        sure = F.expr("a_done and (risk is null or risk >= b)")
        of = lambda c: F.when(sure, F.col(c))
        met = live.groupBy(F.col("b").alias("id")).agg(
            F.min(of("a_slot")).alias("s"), F.min_by("a", of("a_slot")).alias("holder"), F.min_by("up", of("a_slot")).alias("takes"),
            F.min(F.when(~sure, F.when(F.col("a_done"), F.col("a_slot")).otherwise(F.col("a_low")))).alias("wait"))
        judged = written(nodes.where("not done").select("id").join(met, "id", "left").withColumn("ready", F.expr("wait is null or coalesce(wait >= s, false)")))
        ready = judged.where("ready")
        moved = ready.where("takes").select(F.col("holder").alias("id"), F.col("id").alias("taken"))
        fate = judged.select("id", "ready", F.coalesce("s", "id").alias("got"), (F.col("s").isNull() | F.coalesce("takes", F.lit(False))).alias("wins"), F.least("id", "s", "wait").alias("bound"))
        last, nodes = nodes, written(
            nodes.join(fate, "id", "left").join(moved, "id", "left").select(
                "id", (F.col("done") | F.coalesce("ready", F.lit(False))).alias("done"), F.when(F.col("ready"), F.col("wins")).otherwise(F.col("held")).alias("held"),
                F.when(F.col("ready"), F.col("got")).otherwise(F.col("slot")).alias("slot"), F.coalesce("taken", "until").alias("until"), F.greatest("low", F.coalesce("bound", "low")).alias("low")))
        dropped(last, judged)
    return nodes.select("id", "slot", (F.col("held") & F.col("until").isNull()).alias("kept"))
