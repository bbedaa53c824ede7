"""Canonical names of technologies and their rewriting in texts, all terms in one pass.

An automaton over all terms walks the lower-cased text once, whatever their number; of the terms that stand there as
whole words the leftmost wins, and of those the longest. Replacing terms one by one, longest first, gives the same where no
replacement makes or breaks another term's place; where two overlap ('spring web flux' and 'web flux') the longest that
starts first is taken.
"""

from __future__ import annotations

import re
from collections.abc import Mapping
from functools import lru_cache

import ahocorasick
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Names whose broken form is the name with spaces at its joints (fixed values).
JOINED = (
    "FastAPI", "LangGraph", "LangChain", "LangSmith", "PostgreSQL", "MySQL", "MongoDB", "NumPy", "PyTorch", "OpenAI", "OpenRouter", "WebSockets", "WebSocket", "WebFlux",
    "Spring WebFlux", "MuleSoft", "YouTube", "RxJS", "NgRx", "gRPC", "IoT", "5G", "HTML5", "CSS3", "ES6", "OAuth2", "AngularJS", "ServiceNow", "DB2", "J2EE", "K8s", "OpenShift",
    "WebSphere", "PrimeFaces", "DevOps", "TypeScript", "JavaScript", "EC2", "S3", "GraphQL", "GitHub", "GitLab", "CloudWatch", "DynamoDB", "BigQuery",
)
#: Names that are only spelt right (fixed values).
SPELT = (
    "XGBoost", "MLflow", "Elasticsearch", "CI/CD", "REST API", "Spring Boot", "AWS", "GCP", "SQL", "HTML", "CSS", "API", "Docker", "Kubernetes", "Redis", "Celery", "FAISS", "Qdrant", "Pandas", "React",
    "Angular", "Vue", "Django", "Flask", "Python", "Java", "Git", "Jenkins", "Terraform", "Kafka", "Spark", "Bedrock", "MCP", "RAG", "LLM", "LLMs", "NLP", "Node.js", "Next.js", "Scikit-learn",
)
#: Other spellings (fixed values).
OTHER = {
    "postgres": "PostgreSQL", "sklearn": "Scikit-learn", "sci kit learn": "Scikit-learn", "scikit learn": "Scikit-learn", "nodejs": "Node.js", "node js": "Node.js", "nextjs": "Next.js", "next js": "Next.js",
    "react js": "React", "vue js": "Vue", "j2 ee": "J2EE", "ci cd": "CI/CD", "cicd": "CI/CD", "c i / c d": "CI/CD", "power bi": "Power BI", "powerbi": "Power BI", "elastic search": "Elasticsearch",
    "xg boost": "XGBoost", "ml flow": "MLflow", "hugging face": "Hugging Face", "huggingface": "Hugging Face", "model context protocol": "Model Context Protocol",
    "retrieval augmented generation": "Retrieval-Augmented Generation",
}
#: Further tokens that no repair of spaces may cut (fixed values).
UNCUT = ("Elasticsearch", "XGBoost", "MLflow", "Node.js", "Next.js", "FAISS", "Qdrant", "Scikit-learn", "HuggingFace", "Bedrock", "LLM", "LLMs", "RAG", "MCP", "NLP")


def broken(name: str) -> str:
    """A name with spaces where a small letter meets a capital and where letters meet digits, lower-cased."""
    return re.sub(r"(?<=[a-z])(?=[A-Z])|(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])", " ", name).lower()


TERMS: dict[str, str] = {broken(n): n for n in JOINED} | {n.lower(): n for n in (*JOINED, *SPELT)} | OTHER
PROTECTED: tuple[str, ...] = tuple(sorted({n for n in JOINED if " " not in n} | set(UNCUT), key=lambda n: (-len(n), n)))

_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_SPACED = re.compile(r"(?i)\b(?:EC\s+2|S\s+3|CI\s*/\s*CD|CI\s+CD|K\s*8\s*s|J\s*2\s*EE|DB\s+2|5\s+G)\b")
_VERSION = re.compile(r"(?i)\bv\s*(\d+)\b")
_BEDROCK = re.compile(r"(?i)\b(?:AWS\s+)*Bedrock\b")
_DOUBLED = re.compile(r"(?i)\b(?:AWS\s+){2,}")


@lru_cache(maxsize=8)
def _automaton(terms: tuple[str, ...]) -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for t in terms:
        found.add_word(t, len(t))
    found.make_automaton()
    return found


def _in_word(text: str, at: int) -> bool:
    return 0 <= at < len(text) and (text[at].isalnum() or text[at] == "_")


def rewrite(text: str, terms: Mapping[str, str] = TERMS) -> str:
    """The text with every whole term (lower-case keys) by its name; leftmost, then longest."""
    found = []
    for end, size in _automaton(tuple(terms)).iter(text.translate(_LOWER)):
        start = end + 1 - size
        # a word's edge on either side, as a term's own edge asks for
        if _in_word(text, start - 1) != _in_word(text, start) and _in_word(text, end) != _in_word(text, end + 1):
            found.append((start, -size))
    out, at = [], 0
    for start, size in sorted(found):
        if start >= at:
            out += [text[at:start], terms[text[start : start - size].translate(_LOWER)]]
            at = start - size
    return "".join([*out, text[at:]]) if out else text


def restore(text: str | None) -> str | None:
    """Names restored: the terms, then numbers apart from their letters, one AWS before Bedrock, and versions."""
    if not text:
        return text
    out = rewrite(text)
    if "Bedrock" in out:
        out = _BEDROCK.sub("AWS Bedrock", out)
    if "AWS" in out:
        out = _DOUBLED.sub("AWS ", out)
    out = _SPACED.sub(lambda m: TERMS[re.sub(r"\s+", "", m[0]).lower()], out)
    return _VERSION.sub(r"v\1", out)


def normalize(token: str | None) -> str:
    """One skill or tool by its canonical name; what is unknown stays, without marks at its ends."""
    raw = re.sub(r"\s+", " ", (token or "").strip(" .,:;|/"))
    fixed = restore(raw) or ""
    return TERMS.get(fixed.casefold(), fixed)


def restore_names(c: Column) -> Column:
    return F.pandas_udf(lambda s: s.map(restore, na_action="ignore"), "string")(c)


def rewrite_terms(c: Column, terms: Mapping[str, str]) -> Column:
    """Other terms in one pass; keys in lower case."""

    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: rewrite(x, terms), na_action="ignore")

    return F.pandas_udf(run, "string")(c)


def normal_name(c: Column) -> Column:
    return F.pandas_udf(lambda s: s.map(normalize), "string")(c)
