"""The secret scan: its features against plain code, and what the forest learns from planted findings."""

import math
import random
import string

import numpy as np
from pyspark.sql import functions as F

from starloom.llm import secret_scan

PROSE = "the river runs past an old mill and the people of the town walk there in summer while boats pass below "


def _docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


def _prose(spark, n=120):
    draw = random.Random(8)
    words = PROSE.split()
    return _docs(spark, [(i, " ".join(draw.choices(words, k=80)), None) for i in range(n)])


def test_features_against_plain_code():
    common = np.zeros(1 << secret_scan.GRAM_BITS, bool)
    for word in ("mill", "boat"):
        common[secret_scan._gram_buckets(np.frombuffer(word.encode(), np.uint8))] = True
    draw = random.Random(2)
    for _ in range(300):
        value = "".join(draw.choices(string.ascii_letters + string.digits + "+/_=-", k=draw.randint(4, 60))) + draw.choice(("mill", "Boat", ""))
        lead = draw.choice(("commit ", "my token = ", 'Password: "', "sha (id) ", "old mill ", ""))
        tail = draw.choice((" is the key", " of the page", ""))
        path = draw.choice((None, "tests/a.py", "conf/app.yml", "essay", "latest/b.txt"))
        text = f"{lead}{value}{tail}"
        got = dict(zip(secret_scan.FEATURES, secret_scan.describe(text, len(lead), len(lead) + len(value), path, common), strict=True))
        kinds = ["d" if c in string.digits else "u" if c in string.ascii_uppercase else "l" if c in string.ascii_lowercase else "s" for c in value]
        n = len(value)
        grams = [value[i : i + 4].encode() for i in range(n - 3)]
        known = [common[secret_scan._gram_buckets(np.frombuffer(g, np.uint8))[0]] for g in grams]
        beside = "".join(c if c in string.ascii_lowercase else " " for c in f"{lead} {tail}".lower()).split()
        plain = {
            "length": n,
            "digits": kinds.count("d") / n,
            "uppers": kinds.count("u") / n,
            "signs": kinds.count("s") / n,
            "transitions": sum(a != b for a, b in zip(kinds, kinds[1:], strict=False)) / (n - 1),
            "entropy": -sum(value.count(c) / n * math.log2(value.count(c) / n) for c in set(value)),
            "vowels": sum(c in "aeiouAEIOU" for c in value) / n,
            "coverage": sum(known) / len(known),
            "credential": lead.startswith(("my token", "Password")),
            "assigned": "=" in lead or ":" in lead,
            "quoted": lead.endswith('"'),
            "secret_words": sum(w in secret_scan.CREDENTIAL_WORDS for w in beside),
            "public_words": sum(w in secret_scan.PUBLIC_WORDS for w in beside),
            "trial_path": path == "tests/a.py",
            "config_path": path in ("tests/a.py", "conf/app.yml"),
        }
        assert got.keys() == plain.keys()
        for name, value_of in plain.items():
            assert math.isclose(got[name], float(value_of), abs_tol=1e-9), (name, text)


def test_forest_on_held_out_findings_and_its_features(spark):
    docs = _prose(spark)
    common, texts = secret_scan.common_grams(docs)
    assert texts == 120
    findings = secret_scan.planted_findings(docs, common, texts).cache()
    held = F.pmod(F.xxhash64("value"), F.lit(5)) == 0
    forest = secret_scan.train_forest(findings.where(~held))
    scored = secret_scan.score_findings(findings.where(held), forest).select("label", (F.col("score") >= 0.5).cast("int").alias("said"))
    counts = {(r["label"], r["said"]): r["count"] for r in scored.groupBy("label", "said").count().collect()}
    hits = counts[1, 1]
    assert hits >= 300
    assert hits / (hits + counts.get((0, 1), 0)) >= 0.97
    assert hits / (hits + counts.get((1, 0), 0)) >= 0.97
    weight = dict(zip(secret_scan.FEATURES, forest.featureImportances.toArray(), strict=True))
    assert max(weight.values()) < 0.5
    assert all(weight[f] > 0.005 for f in ("length", "transitions", "coverage", "trial_path", "public_words", "secret_words"))
    findings.unpersist()


def test_planted_findings_do_not_depend_on_the_partitions(spark):
    docs = _prose(spark, 20)
    common, texts = secret_scan.common_grams(docs)
    rows = [sorted(secret_scan.planted_findings(docs.repartition(n), common, texts).collect()) for n in (1, 5)]
    assert rows[0] == rows[1]
    few = secret_scan.planted_findings(docs, common, 10 * texts, carriers=20)
    assert few.select("doc_id").distinct().count() < texts


def test_bare_keys_are_found_and_hashes_left(spark):
    draw = random.Random(5)
    rows, secrets, public = [], set(), set()
    for i in range(20):
        key = "AKIA" + "".join(draw.choices(string.ascii_uppercase + string.digits, k=16))
        commit = "".join(draw.choices("0123456789abcdef", k=40))
        rows.append((i, f"{PROSE} {key} {PROSE} see commit {commit} {PROSE}", "essay"))
        secrets.add((i, key))
        public.add((i, commit))
    found = secret_scan.scan_secrets(_docs(spark, rows).unionAll(_prose(spark).selectExpr("doc_id + 1000", "text", "source"))).collect()
    assert {(r.doc_id, r.value) for r in found if r.is_secret} == secrets
    assert public <= {(r.doc_id, r.value) for r in found}


def test_labelled_findings_of_ones_own_replace_the_planted_ones(spark):
    docs = _docs(spark, [(1, f"token = {'ab12' * 5} and {'mill' * 5}", None), (2, None, None), (3, "", "x")])
    common, _ = secret_scan.common_grams(docs)
    own = secret_scan.find_candidates(docs, common).withColumn("label", F.col("value").startswith("mill").cast("int"))
    found = {r.value: r.is_secret for r in secret_scan.scan_secrets(docs, labelled=own).collect()}
    assert found == {"ab12" * 5: False, "mill" * 5: True}
    only = secret_scan.scan_secrets(docs, labelled=own.where("label = 1")).collect()
    assert len(only) == 2 and not any(r.is_secret or r.score for r in only)
