"""Histogram sort into shards of near equal bytes, in DataFrame operations alone."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from starloom.llm.common import text_of, written

PROBE_BITS = 12
LOWEST = -(1 << 63)


def _histogram(rows: DataFrame, bucket: Column) -> dict[int, int]:
    """Exact bytes of each bucket; the buckets are at most probes * splitters."""
    return {r[0]: r[1] for r in rows.groupBy(bucket.alias("bucket")).agg(F.sum("size")).collect()}


def _place(counts: dict[int, int], buckets: list[int], target: float, below: int, slack: float):
    """Walk the buckets up to the target: ("cut", bucket) or ("open", bucket, bytes below)."""
    for bucket in buckets:
        inside = counts[bucket]
        if below + inside >= target - slack:
            if abs(target - below) <= slack and abs(target - below) <= abs(below + inside - target):
                return "cut", bucket, below
            if abs(below + inside - target) <= slack:
                return "cut", bucket + 1, below + inside
            return "open", bucket, below
        below += inside
    return "cut", buckets[-1] + 1, below


def _refine(
    rows: DataFrame, column: str, targets: dict, slack: float, start_bits: int, low: int, values_split: bool
):
    """Narrow each splitter to a value of ``column``, some bits a round.

    targets: splitter -> (bytes wanted, bytes below the range). Gives splitter ->
    (value, done, bytes below); what is not done lies within one single value.
    """
    out, offset = {}, F.col(column) - F.lit(low)
    shift = max(0, start_bits - PROBE_BITS)
    inside = {s: (None, want, below) for s, (want, below) in targets.items()}
    while inside:
        open_buckets = sorted({b for b, _, _ in inside.values() if b is not None})
        part = rows
        if open_buckets:
            part = rows.where(F.shiftright(offset, last).isin(open_buckets))
        counts = _histogram(part, F.shiftright(offset, shift))
        todo = {}
        for splitter, (bucket, want, below) in inside.items():
            own = sorted(b for b in counts if bucket is None or b >> (last - shift) == bucket)
            kind, at, under = _place(counts, own, want, below, slack)
            if kind == "cut":
                out[splitter] = ((at << shift) + low, True, under)
            elif shift == 0:
                # One value holds the target; its near end, in case it cannot be split.
                near = at + (want - under > counts[at] / 2)
                out[splitter] = ((at if values_split else near) + low, False, under)
            else:
                todo[splitter] = (at, want, under)
        inside, last, shift = todo, shift, max(0, shift - PROBE_BITS)
    return out


def splitters(rows: DataFrame, shards: int, tolerance: float) -> list[tuple[int, int]]:
    """Keys (text hash, id) at which the shards 1, 2, ... begin."""
    total = rows.agg(F.sum("size")).first()[0]
    if not total:
        return []
    slack = tolerance * total / shards
    targets = {s: (total * s / shards, 0) for s in range(1, shards)}
    found = _refine(rows, "text_hash", targets, slack, 64, 0, True)
    cuts = {s: (value, LOWEST) for s, (value, done, _) in found.items() if done}
    # A target inside the copies of one text: they are split by their ids.
    for value in {v for v, done, _ in found.values() if not done}:
        copies = rows.where(F.col("text_hash") == F.lit(value))
        low, high = copies.agg(F.min("id"), F.max("id")).first()
        if high - low >= 1 << 62:  # null ids beside others
            low = copies.where(F.col("id") > LOWEST).agg(F.min("id")).first()[0] if low == LOWEST else low
            copies = copies.where(F.col("id") >= low)
        own = {s: (targets[s][0], under) for s, (v, done, under) in found.items() if not done and v == value}
        bits = max(1, (high - low).bit_length())
        for s, (at, _, _) in _refine(copies, "id", own, slack, bits, low, False).items():
            cuts[s] = (value, at)
    return [cuts[s] for s in sorted(cuts)]


def _shard_of(cuts: list[tuple[int, int]]) -> Column:
    key, row_id = F.col("text_hash"), F.col("id")
    steps = []
    for value, at in cuts:
        beyond = key > F.lit(value) if at != LOWEST else key >= F.lit(value)
        if value > (1 << 63) - 1:
            continue
        if at != LOWEST:
            beyond = beyond | ((key == F.lit(value)) & (row_id >= F.lit(at)))
        steps.append(beyond.cast("int"))
    return reduce(lambda a, b: a + b, steps, F.lit(0))


def shard_documents(
    docs: DataFrame,
    shards: int = 40,
    text: str = "text",
    doc_id: str = "doc_id",
    tolerance: float = 0.002,
    rows_per_range: int = 1_000_000,
) -> DataFrame:
    """Place every document in a shard so that the shards' bytes are near equal.

    Documents are ordered by (hash of the text, id). Rounds of exact histograms
    over ever finer probes find the keys at which a shard is full, to within
    ``tolerance`` of a shard; then rows move once. Copies of a text lie in one
    shard, unless there are so many that sizes would differ: those are split by
    id. Rows alike in text and id stay together.

    A size is the UTF-8 bytes of the text plus 16; a null text counts as an
    empty one, a null id sorts first. ``slot`` numbers the rows of a shard from
    0 without gaps. Only id, text and what is computed from them is returned,
    so columns of the documents never clash. No document: no row.
    """
    rows = written(
        docs.select(
            F.col(doc_id).alias("doc_id"),
            (F.octet_length(text_of(text)) + F.lit(16)).cast("long").alias("size"),
            F.crc32(text_of(text)).alias("text_crc32"),
            F.xxhash64(text_of(text)).alias("text_hash"),
            F.coalesce(F.col(doc_id).cast("long"), F.lit(LOWEST)).alias("id"),
        )
    )
    cuts = splitters(rows, shards, tolerance)
    n_rows = rows.count()
    ranges = max(1, math.ceil(n_rows / (shards * rows_per_range)))
    placed = rows.withColumn("shard", _shard_of(cuts)).withColumn("part", F.pmod(F.xxhash64("id"), F.lit(ranges)).cast("int"))
    return _with_slots(placed).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def _with_slots(placed: DataFrame) -> DataFrame:
    """Number the rows of each shard; several tasks share a large shard."""
    spark: SparkSession = placed.sparkSession
    starts, seen = [], {}
    counts = placed.groupBy("shard", "part").count().collect()  # shards * ranges numbers
    for shard, part, n in sorted(map(tuple, counts)):
        starts.append((shard, part, seen.get(shard, 0)))
        seen[shard] = seen.get(shard, 0) + n
    start = spark.createDataFrame(starts, "shard int, part int, before long")
    place = Window.partitionBy("shard", "part").orderBy("text_hash", "id", "size")
    numbered = placed.withColumn("place", F.row_number().over(place) - 1)
    return numbered.join(F.broadcast(start), ["shard", "part"]).withColumn("slot", F.col("before") + F.col("place"))
