"""Registration of queries with their SQL."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..operators.ranking import SIGNALS, TECHNOLOGIES, VERBS, any_word
from ..sources.tables import Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    """Registers a plan ``f(tables)`` under its name."""

    def add(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        @functools.wraps(f)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(Tables(spark, sf_dir))

        QUERIES[f.__name__] = run
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# ---------------------------------------------------------------- SQL pieces

#: doc_id, source, ln, line of non-empty lines.
LINE = """line AS (SELECT doc_id, source, ln::BIGINT AS ln, line FROM (
  SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line,
         generate_subscripts(string_split(text, chr(10)), 1) AS ln FROM documents) WHERE line <> '')"""


def squash(c: str) -> str:
    return rf"trim(regexp_replace(regexp_replace({c}, '^[\s•*·-]+', ''), '\s+', ' ', 'g'))"


def words(c: str) -> str:
    return rf"list_filter(string_split(regexp_replace({c}, '\s+', ' ', 'g'), ' '), lambda w: w <> '')"


def key(c: str) -> str:
    return f"regexp_replace(lower({c}), '[^a-z0-9]+', '', 'g')"


def heading(c: str) -> str:
    t = squash(c)
    return f"({t} <> '' AND len({words(t)}) <= 6 AND length({t}) < 40 AND NOT regexp_matches({t}, '[.!?,;:]$') AND regexp_matches({t}, '[A-Za-z]'))"


def score(c: str) -> str:
    words = " + ".join(f"CASE WHEN regexp_matches(lower({c}), '{any_word(w)}') THEN {p} ELSE 0.0 END" for w, p in ((VERBS, "2.0"), (TECHNOLOGIES, "1.0"), (SIGNALS, "2.5")))
    return (
        f"({words} + CASE WHEN regexp_matches({c}, '[0-9]') THEN 3.0 ELSE 0.0 END + CASE WHEN length({c}) BETWEEN 80 AND 280 THEN 2.0 WHEN length({c}) > 280 THEN 0.5 ELSE 0.0 END"
        f" - CASE WHEN regexp_matches(lower({c}), 'responsible for|worked on') THEN 1.0 ELSE 0.0 END)::DOUBLE"
    )
