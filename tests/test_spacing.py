"""Space repair against a plain segmenter, and the glossary against one replacement a term."""

import random
import re

import pytest
from pyspark.sql import functions as F

from paperloom.functions import glossary, spacing

WORDS = sorted(spacing.LEXICON)


def plain_segment(run):
    """The rule said again: slices against the list, longest first."""
    if len(run) < 10:
        return run
    low, parts, i = run.lower(), [], 0
    while i < len(low):
        hit = next((low[i:j] for j in range(min(len(low), i + 24), i + 3, -1) if low[i:j] in WORDS), None)
        if hit:
            parts.append(hit)
            i += len(hit)
            continue
        if not parts or parts[-1] in WORDS:
            parts.append("")
        parts[-1] += low[i]
        i += 1
    return " ".join(parts) if len(parts) > 1 and sum(p in WORDS for p in parts) >= 2 else run


def test_segments_equal_a_plain_segmenter():
    rng = random.Random(1)
    for _ in range(3000):
        pieces = [rng.choice(WORDS) if rng.random() < 0.7 else "".join(rng.choices("abcthe", k=rng.randint(1, 5))) for _ in range(rng.randint(1, 6))]
        run = "".join(p.title() if rng.random() < 0.2 else p for p in pieces)
        assert spacing.segment(run) == plain_segment(run), run


@pytest.mark.parametrize(("text", "want"), [
    ("Developedscalableapplicationsusingmachinelearning", "developed scalable applications using machine learning"),
    ("BuiltenterpriseintegrationsforEC2 andKubernetes platform2platform", "built enterprise integrations for EC2 and Kubernetes platform 2 platform"),
    ("This is a text of usual density, with nothing to mend in it at all.", "This is a text of usual density, with nothing to mend in it at all."),
    ("productiongradesystems mail first.last2x@example.org", "production grade systems mail first.last2x@example.org"),  # addresses stay whole
    ("productiongradesystems for the user @somebody", "productiongradesystems for the user @somebody"),  # lines with other @ stay
    ("short Text2x", "short Text2x"), ("", ""), (None, None),
    ("12345 67890 12345 67890 12345", "12345 67890 12345 67890 12345"),
    ("line of usual density here, with spaces\n\nproductiongradeenterprisesystems", "line of usual density here, with spaces\n\nproduction grade enterprise systems"),
])
def test_repair(text, want):
    got = spacing.repair(text)
    assert got == want


def test_seams_part_names_inside_runs():
    """Names are kept only where they stand as whole words."""
    assert spacing.repair("UsedPostgreSQLforstructuredanalysis and FastAPIservices") == "Used Postgre sqlfor structured analysis and Fast APIservices"


def test_documents_of_usual_density_come_back(spark, sf_dir):
    """Only texts with few spaces or a long run that holds two words change; all others differ by names at most."""
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("text", spacing.repair_spaces(F.col("text")).alias("fixed")).collect()
    for r in rows:
        runs = [w for w in re.findall("[A-Za-z]{10,}", r.text) if plain_segment(w) != w]
        letters = max(1, sum(map(str.isalpha, r.text)))
        if not runs and r.text.count(" ") / letters >= 0.1 and all(re.sub(r"\s+", " ", x).strip() == x.strip() for x in r.text.splitlines()):
            assert r.fixed == glossary.restore(r.text)


def test_lost_spaces_of_lexicon_texts_are_found_again():
    rng = random.Random(2)
    long = [w for w in WORDS if len(w) >= 7]
    for _ in range(200):
        words = [rng.choice(long) for _ in range(8)]
        got = spacing.repair("".join(words))
        assert got == glossary.restore(plain_segment("".join(words))) and got.replace(" ", "").lower().replace("awsbedrock", "bedrock") == "".join(words)


def test_restore_examples():
    assert glossary.restore("across Groq, OpenRouter, and AWS AWS AWS Bedrock.") == "across Groq, OpenRouter, and AWS Bedrock."
    assert glossary.restore("integrated with bedrock and Spring AI") == "integrated with AWS Bedrock and Spring AI"
    spaced = "Mule Soft, Spring Web Flux, You tube, Rx JS, g RPC, Io T, 5 G, Angular JS, HTML 5, CSS 3, Service Now, DB 2, J 2 EE, K 8 s, Open Shift, Web Sphere"
    assert glossary.restore(spaced) == "MuleSoft, Spring WebFlux, YouTube, RxJS, gRPC, IoT, 5G, AngularJS, HTML5, CSS3, ServiceNow, DB2, J2EE, K8s, OpenShift, WebSphere"
    assert glossary.restore("EC   2 and ci / cd, V 3") == "EC2 and CI/CD, v3"
    assert glossary.normalize(" postgres. ") == "PostgreSQL" and glossary.normalize("fast  api") == "FastAPI" and glossary.normalize("Odd Tool") == "Odd Tool" and glossary.normalize(None) == ""


def test_one_pass_equals_ordered_replacements_where_terms_stand_apart():
    rng = random.Random(3)
    terms = sorted(glossary.TERMS, key=lambda t: (-len(t), t))
    for _ in range(300):
        parts = [rng.choice(terms) if rng.random() < 0.6 else rng.choice(["xapi", "apix", "sparkle", "word", "é"]) for _ in range(8)]
        text = " ; ".join(p.upper() if rng.random() < 0.3 else p for p in parts)
        want = text
        for t in terms:
            want = re.sub(rf"(?i)\b{re.escape(t)}\b", glossary.TERMS[t], want)
        assert glossary.rewrite(text) == want


def test_overlaps_take_the_leftmost_then_the_longest():
    terms = {"a b": "AB", "b c d": "BCD", "a b c": "ABC", "b": "B"}
    assert glossary.rewrite("a b c d", terms) == "ABC d" and glossary.rewrite("b c d a b", terms) == "BCD AB" and glossary.rewrite("ab b_ b", terms) == "ab b_ B"


def test_every_name_has_its_spellings():
    assert glossary.broken("PostgreSQL") == "postgre sql" and glossary.broken("J2EE") == "j 2 ee" and glossary.broken("gRPC") == "g rpc" and glossary.broken("OAuth2") == "oauth 2"
    assert len(glossary.TERMS) > 150 and all(t == t.lower() for t in glossary.TERMS)
