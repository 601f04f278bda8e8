"""Exact dedup against a dictionary, on small tables, hot texts and odd rows."""

import hashlib
import random
import re

from pyspark.sql import functions as F

from starloom.llm.common import written
from starloom.llm.exact_dedup import drop_exact_copies, exact_groups, heavy_digests

SCHEMA = "doc_id long, text string"


def sha(text):
    return hashlib.sha256(re.sub(r"[\x20\x09-\x0D]+", " ", text or "").encode()).hexdigest()


def plain(rows):
    groups = {}
    for doc_id, text in rows:
        groups.setdefault(sha(text), []).append(doc_id)
    least = {k: min((i for i in ids if i is not None), default=None) for k, ids in groups.items()}
    return groups, least


def held_against_plain(rows, found):
    groups, least = plain(rows)
    assert sorted(map(repr, ((r.doc_id, r.text_sha256) for r in found))) == sorted(map(repr, ((i, sha(t)) for i, t in rows)))
    for r in found:
        assert (r.keep_id, r.group_size) == (least[r.text_sha256], len(groups[r.text_sha256]))
    kept = [r for r in found if r.kept]
    assert len(kept) == len(groups) and all(r.doc_id == r.keep_id for r in kept)


def test_groups_against_plain(spark):
    draw = random.Random(3)
    spaces = (" ", "  ", "\n", "\t \r", "\x0b\x0c")
    rows = [(i, draw.choice(spaces).join(draw.choice("abc") for _ in range(draw.randrange(1, 6)))) for i in range(2000)]
    draw.shuffle(rows)
    held_against_plain(rows, exact_groups(spark.createDataFrame(rows, SCHEMA).repartition(7)).collect())


def test_odd_rows(spark):
    """Null and empty texts are one group, white space another; null ids come last; repeated rows keep one."""
    long = "word \n" * 300_000
    rows = [(5, None), (4, ""), (3, " \n"), (6, "\t"), (None, "x"), (None, "x"), (9, "y"), (None, "y"), (7, "z"), (7, "z"), (8, long), (2, long + " "), (1, "a b"), (0, "a b")]
    df = spark.createDataFrame(rows, SCHEMA)
    for name in ("row", "digest", "size", "winner", "kept", "top", "own"):
        df = df.withColumn(name, F.lit("clash"))
    held_against_plain(rows, exact_groups(df).collect())
    stay = drop_exact_copies(df)
    assert stay.columns == df.columns
    assert len(stay.collect()) == len(plain(rows)[0])
    empty = spark.createDataFrame([], SCHEMA)
    assert exact_groups(empty).collect() == [] and drop_exact_copies(empty).collect() == []


def test_heavy_digests_are_counted_exactly_and_not_shuffled(spark):
    """A third of all rows hold one text; it is among the proposals, its count is exact."""
    rows = spark.range(30_000).select(
        F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("t"), F.col("id") % 9001)).alias("digest"), F.col("id").alias("row")
    )
    heavy = {r.digest: r for r in heavy_digests(written(rows), counters=64, most=16).collect()}
    assert heavy["hot"].size == 10_000 and heavy["hot"].winner.doc_id == 0
    assert len(heavy) <= 16
    # Texts beyond the summary's size go by the shuffle, with the same result.
    texts = [(i, "hot" if i % 3 == 0 else f"t{i % 401}") for i in range(3000)]
    held_against_plain(texts, exact_groups(spark.createDataFrame(texts, SCHEMA)).collect())


def test_plan_stays_in_spark(spark):
    plan = exact_groups(spark.createDataFrame([(1, "a"), (2, "a")], SCHEMA))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "BroadcastHashJoin" in plan
