"""Exact dedup: heavy hitters are settled map-side by a broadcast, the rest by an ordinary shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starloom.llm.common import text_of, written

# Counters of the Misra-Gries summary: it holds 3/4 of them, and misses no text
# that more than about one document in 800 holds.
COUNTERS = 4096
# Digests that are broadcast at most; a row of the broadcast has about 100 bytes.
MOST_HEAVY = 1024
SPACES = r"[\x20\x09-\x0D]+"


def normal_text(column: str = "text") -> Column:
    """Each run of white space becomes one space; null counts as empty."""
    return F.regexp_replace(text_of(column), SPACES, " ")


def _smallest() -> Column:
    """The row that stays: smallest id, null last; rows alike in id by their place in the table."""
    return F.min(F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "row"))


def heavy_digests(rows: DataFrame, counters: int = COUNTERS, most: int = MOST_HEAVY) -> DataFrame:
    """(digest, winner, size) of the digests that a Misra-Gries summary finds frequent, counted exactly.

    Spark's ``approx_top_k`` keeps such a summary of ``counters`` counters in
    each task and merges them. What it names is only a proposal: the second pass
    counts these digests in all rows and finds the row that stays, so its errors
    cost speed at most. Digests of a single row are left to the shuffle.
    """
    top = F.expr(f"approx_top_k(digest, {int(most)}, {int(counters)})")
    proposed = written(rows.agg(top.alias("top")).select(F.explode("top.item").alias("digest")))
    return (
        rows.join(F.broadcast(proposed), "digest")
        .groupBy("digest")
        .agg(F.count("*").alias("size"), _smallest().alias("winner"))
        .where("size > 1")
    )


def _decided(rows: DataFrame) -> DataFrame:
    """rows (doc_id, row, digest) with winner and size of their group of equal digests."""
    heavy = F.broadcast(written(heavy_digests(rows)))
    known = rows.join(heavy, "digest", "left")
    settled = known.where("size is not null")
    rest = known.where("size is null").select(*rows.columns)
    groups = rest.groupBy("digest").agg(F.count("*").alias("size"), _smallest().alias("winner"))
    return settled.unionByName(rest.join(groups, "digest"))


def exact_groups(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when their SHA-256 is, after each run of white space has
    become one space. Of a group the row with the smallest doc_id stays, a null
    id after all others; of rows alike in text and id exactly one. Null and empty
    texts are one group, a text of white space alone (one space) another. Other
    columns are not carried, so none clashes. No document gives no row.

    Only a digest, the id and a row number are written and shuffled, not the texts.
    Copies of a frequent text are not shuffled at all.
    """
    rows = written(
        docs.select("doc_id", F.sha2(normal_text(text), 256).alias("digest")).withColumn("row", F.monotonically_increasing_id())
    )
    return _decided(rows).select(
        "doc_id",
        F.col("winner.doc_id").alias("keep_id"),
        F.col("size").alias("group_size"),
        (F.col("winner.row") == F.col("row")).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )


def drop_exact_copies(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents that stay, with all their columns; groups as in :func:`exact_groups`.

    The documents are written once with their row number, so that exactly one
    row of a group stays even where rows are alike in all columns.
    """
    own = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    numbered = written(
        docs.select(own.alias("own"), F.col("doc_id"), F.sha2(normal_text(text), 256).alias("digest")).withColumn(
            "row", F.monotonically_increasing_id()
        )
    )
    rows = _decided(numbered.select("doc_id", "row", "digest"))
    stay = rows.where("winner.row = row").select("row")
    return numbered.join(stay, "row", "left_semi").select("own.*")
