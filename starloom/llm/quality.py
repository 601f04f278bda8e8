"""Quality rules: base signals and a hashed n-gram log-likelihood ratio, in SQL functions alone."""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starloom.llm.common import text_of, written

BUCKETS = 1 << 16
WINDOW = 8
_SPACES = r"[\x20\x09-\x0D]+"


def _words(text: Column) -> Column:
    return F.array_remove(F.split(text, _SPACES), "")


def base_signals(docs: DataFrame, text: str = "text", window: int = WINDOW) -> DataFrame:
    """Add the words of each document and its base signals.

    Added: words, hashes (of the words), n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed. A null text has no word. Columns of these names are replaced.
    """
    body = text_of(text)
    lines = F.filter(F.split(body, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    found = docs.withColumn("words", _words(body)).withColumn("n_words", F.size("words").cast("long"))
    found = found.withColumn("lines", lines).withColumn("hashes", _hashes("words"))
    # A hash for each window of words; most documents repeat none of them.
    grams = F.when(
        F.col("n_words") >= window,
        F.transform(F.sequence(F.lit(1), F.size("words") - window + 1), lambda i: F.xxhash64(F.slice("hashes", i, window))),
    ).otherwise(F.array().cast("array<bigint>"))
    found = found.withColumn("grams", grams)
    found = found.withColumn("sorted", F.when(F.size(F.array_distinct("grams")) < F.size("grams"), _sorted_places("grams")))
    twice = F.filter("sorted", lambda g, i: (F.get("sorted", i - 1)["h"] == g["h"]) | F.coalesce(F.get("sorted", i + 1)["h"] == g["h"], F.lit(False)))
    found = found.withColumn("starts", F.sort_array(F.transform(twice, lambda g: g["i"])))
    covered = F.aggregate(
        "starts",
        F.struct(F.lit(0).alias("n"), F.lit(-window).alias("end")),
        lambda a, p: F.struct((a["n"] + window - F.greatest(F.lit(0), a["end"] - p)).alias("n"), (p + window).alias("end")),
        lambda a: a["n"],
    )
    return (
        found.withColumn("word_chars", F.length(F.array_join("words", "")).cast("long"))
        .withColumn("n_symbols", (F.length(body) - F.length(F.translate(body, "#*$%&|<>", ""))).cast("long"))
        .withColumn("n_dup_lines", (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"))
        .withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long"))
        .withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))
        .drop("lines", "grams", "sorted", "starts")
    )


def _sorted_places(grams: str) -> Column:
    return F.array_sort(F.transform(grams, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))


def _hashes(words: str | Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def hashed_grams(hashes: str, buckets: int = BUCKETS) -> Column:
    """Buckets of the words and of the pairs of neighbours (the last word pairs with nothing)."""
    single = F.transform(hashes, lambda h: F.pmod(h, F.lit(buckets)).cast("int"))
    after = F.slice(hashes, 2, 2147483647)
    pairs = F.zip_with(hashes, after, lambda a, b: (F.pmod(F.xxhash64(a, b), F.lit(buckets)) + buckets).cast("int"))
    return F.concat(single, pairs)


class QualityModel(NamedTuple):
    """``weights``: bucket, weight (log ratio); at most 2 * buckets rows. ``threshold``: least score kept."""

    weights: DataFrame
    threshold: float


def fit_ratio(docs: DataFrame, trusted: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, weight): log of the trusted over the raw probability of each hashed n-gram.

    Both multinomials count whole texts, the raw one those of all documents.
    The trusted one is smoothed by one pseudo count a bucket, dealt like the raw
    one; without any trusted document every weight is 0.
    """
    ids = trusted.select("doc_id").where("doc_id IS NOT NULL").distinct().withColumn("is_trusted", F.lit(1))
    # Texts meet the ids, not their far wider words; by a shuffle at any size, as trusted rows grow with the corpus.
    named = docs.where("doc_id IS NOT NULL").select("doc_id", "text").join(ids.hint("shuffle_hash"), "doc_id", "left")
    marked = named.select("text", F.coalesce("is_trusted", F.lit(0)).alias("is_trusted"))
    # Rows without an id have no label, and would all meet in one task.
    given = marked.unionAll(docs.where("doc_id IS NULL").select("text", F.lit(0).alias("is_trusted")))
    hashes = given.select("is_trusted", _hashes(_words(text_of())).alias("hashes"))
    grams = hashes.select("is_trusted", F.explode(hashed_grams("hashes", buckets)).alias("bucket"))
    counts = written(grams.groupBy("bucket").agg(F.count("*").alias("raw"), F.sum("is_trusted").alias("good")))
    n_raw, n_good = counts.agg(F.sum("raw"), F.sum("good")).first()
    n_raw, n_good = n_raw or 1, n_good or 0
    share = F.col("raw") / F.lit(float(n_raw))
    smooth = float(2 * buckets)
    good = (F.col("good") + smooth * share) / F.lit(n_good + smooth)
    return counts.select("bucket", F.log(good / share).alias("weight"))


def score_quality(docs: DataFrame, weights: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """Base signals of each document and ``ratio``, its mean weight over its n-grams.

    ``ratio`` is 0 for a document without words.
    """
    signals = base_signals(docs).withColumn("row", F.monotonically_increasing_id())
    kept = [c for c in signals.columns if c not in ("words", "hashes", "text")]
    grams = signals.select(*kept, F.explode_outer(hashed_grams("hashes", buckets)).alias("bucket"))
    # 2 * buckets rows at most, whatever the corpus.
    weighed = grams.join(F.broadcast(weights), "bucket", "left")
    keys = [F.col(c) for c in kept]
    return weighed.groupBy(*keys).agg(F.coalesce(F.avg("weight"), F.lit(0.0)).alias("ratio")).drop("row")


def judge_quality(docs: DataFrame, labels: DataFrame, keep_share: float = 0.995) -> DataFrame:
    """Judge every document: doc_id, base signals, ratio, base_failed, kept.

    labels: doc_id, quality (1 trusted). Four fifths of the trusted documents
    make the target multinomial; the others, which it has not seen, set the
    threshold: half way between the ``keep_share`` quantile of their ratios and
    that of the other class if the two lie apart, else at the former. Both
    statistics cover all labelled rows; without labels the threshold is 0 - all
    weights are 0 then, so all is kept that passes the base.

    A null text is empty, and fails the base. Null ids have no label. Repeated
    rows are judged each. Only doc_id and text are read.
    """
    known = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    checked = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0
    given = docs.select("doc_id", "text")
    weights = fit_ratio(given, known.where((F.col("quality") == 1) & ~checked))
    scored = written(score_quality(given, weights))
    held = scored.where("NOT base_failed").join(known.where(checked), "doc_id")
    low, high = held.agg(
        F.expr(f"percentile(ratio, {1 - keep_share}) FILTER (WHERE quality = 1)"),
        F.expr(f"percentile(ratio, {keep_share}) FILTER (WHERE quality = 0)"),
    ).first()
    threshold = 0.0 if low is None else low if high is None or high >= low else (low + high) / 2
    if not math.isfinite(threshold):
        raise ValueError("ratios are not finite")
    return scored.withColumn("kept", ~F.col("base_failed") & (F.col("ratio") >= F.lit(threshold)))
