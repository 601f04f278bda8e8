"""Surrogate keys that are a function of the natural keys alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starloom.operators.frozen import freeze
from starloom.session import new_scratch

# A packed key holds the bucket above 33 bits of row number, and
# 200 buckets, Spark's default shuffle width, reproduce the published keys.
ROW_BITS = 33
ROW_MASK = (1 << ROW_BITS) - 1
PACKED_BUCKETS = 200


# Characters of a text key that are looked at at once, and how often more are taken where many keys agree.
PIECE = 32
ROUNDS = 8


def add_surrogate_key(
    df: DataFrame,
    key: str,
    out: str,
    layout: str = "dense",
    *,
    path: str | None = None,
    buckets: int = PACKED_BUCKETS,
    long_text: bool = False,
) -> DataFrame:
    """Append bigint ``out``: unique, at least 1, the same on every run.

    ``key`` must be unique in ``df``. ``dense`` numbers the keys 1..N in
    ascending order, NULL last, and writes the table to ``path`` (a new
    scratch path by default). ``packed`` numbers the keys within each hash
    bucket and leaves gaps; it is written too, and any number of tasks shares a
    bucket. Spark places its range bounds by a sample on the driver, which holds
    the first characters of a text key, never a whole one. Pass ``long_text`` for
    keys of which many may agree in these: then more of the key is used there.
    """
    if layout not in ("dense", "packed"):
        raise ValueError(f"layout must be 'dense' or 'packed', not {layout!r}")
    path = path or new_scratch(df.sparkSession)
    ranked = _dense if layout == "dense" else _packed
    if long_text:
        df = freeze(df, new_scratch(df.sparkSession))
    return ranked(df, key, out, path, buckets, long_text)


def _common_length(one: Column, other: Column) -> Column:
    """Characters that two texts share at the start, found by halving."""
    steps = F.array(*[F.lit(1 << bit) for bit in reversed(range(30))])

    def longer(known: Column, step: Column) -> Column:
        end = known + step
        same = (F.least(F.length(one), F.length(other)) >= end) & (F.substring(one, F.lit(1), end) == F.substring(other, F.lit(1), end))
        return F.when(same, end).otherwise(known)

    return F.aggregate(steps, F.lit(0), longer)


def _text_pieces(df: DataFrame, lead: list[str], key: str) -> tuple[DataFrame, list[Column]]:
    """``df`` and short pieces of a text key that sort its rows and part them evenly.

    The first piece starts the key. Where so many rows agree in all pieces that a
    task would have too many, one more is taken behind all that these rows have in
    common. A Misra-Gries summary of the pieces' hashes (``approx_top_k``) names these
    groups, so nothing is shuffled but two keys for each. Keys that still agree after
    ``ROUNDS`` such steps share a task; the ranks are right all the same.
    """
    spark = df.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    counters = 1 << min(16, max(10, (8 * partitions).bit_length()))
    pieces = [F.substring(key, 1, PIECE)]
    for step in range(ROUNDS):
        agreeing = F.xxhash64(*lead, *pieces)
        hashes = df.where(F.col(key).isNotNull()).select(agreeing.alias("h"))
        top = hashes.agg(F.expr(f"approx_top_k(h, {counters // 8}, {counters})").alias("top"), F.count("*").alias("n")).first()
        # At most counters / 8 numbers come back.
        many = [item["item"] for item in top.top or [] if item["count"] > max(1, top.n // (2 * partitions))]
        if not many:
            break
        shared = f"__shared_{step}"
        groups = (
            df.withColumn("h", agreeing)
            .where(F.col("h").isin(many))
            .groupBy("h")
            .agg(F.min(key).alias("first"), F.max(key).alias("last"))
            .select("h", _common_length(F.col("first"), F.col("last")).alias(shared))
        )
        groups = freeze(groups, new_scratch(spark))
        df = df.withColumn("h", agreeing).join(F.broadcast(groups), "h", "left").drop("h")
        pieces.append(F.substring(F.col(key), F.col(shared) + 1, F.lit(PIECE)))
    return df, pieces


def _placed(df: DataFrame, lead: list[str], key: str, long_text: bool) -> DataFrame:
    """The rows sorted by ``lead`` and ``key`` across partitions, with ``__place``, and nothing else added."""
    columns = df.columns
    pieces = [F.col(key)]
    if long_text:
        df, pieces = _text_pieces(df, lead, key)
    elif dict(df.dtypes)[key] == "string":
        pieces = [F.substring(key, 1, 2 * PIECE)]
    return (
        df.repartitionByRange(*[c.asc_nulls_last() for c in (*map(F.col, lead), *pieces)])
        .sortWithinPartitions(*[F.col(c).asc_nulls_last() for c in (*lead, key)])
        .select(*[f"`{c}`" for c in columns], F.monotonically_increasing_id().alias("__place"))
    )


def _ranked(df: DataFrame, lead: list[str], key: str, path: str, long_text: bool) -> tuple[DataFrame, Column]:
    """The written table, and the rank of its rows by ``lead`` and ``key``, without a one-partition window.

    A range shuffle sorts the keys across partitions. The written table keeps
    each row's partition and its place there, so the rows before it are a sum
    of earlier partition sizes, one number per partition. Where Spark drew the
    range bounds does not matter: the rank is the same for any of them.
    """
    written = freeze(_placed(df, lead, key, long_text), path)
    partition = F.shiftright("__place", ROW_BITS).cast("int")
    # One row per shuffle partition comes back, whatever the size of the table.
    sizes = dict(written.groupBy(partition.alias("p")).agg(F.count("*").alias("n")).collect())
    rows_before, total = [], 0
    for p in range(max(sizes, default=-1) + 1):
        rows_before.append(total)
        total += sizes.get(p, 0)
    # A literal, not a join, so that the size estimate of the table stays true.
    offsets = F.split(F.lit(",".join(map(str, rows_before)) or "0"), ",").cast("array<bigint>")
    place = F.col("__place").bitwiseAND(F.lit(ROW_MASK))
    return written, F.get(offsets, partition) + place + 1


def _dense(df: DataFrame, key: str, out: str, path: str, buckets: int, long_text: bool) -> DataFrame:
    written, rank = _ranked(df, [], key, path, long_text)
    return written.select(*df.columns, rank.alias(out))


def _packed(df: DataFrame, key: str, out: str, path: str, buckets: int, long_text: bool) -> DataFrame:
    """Rank by bucket and key, less the rank before the bucket's first row."""
    bucket = F.pmod(F.hash(key), F.lit(buckets)).cast("bigint")
    written, rank = _ranked(df.withColumn("__bucket", bucket), ["__bucket"], key, path, long_text)
    # One row per bucket comes back.
    first = dict(written.groupBy("__bucket").agg(F.min(rank)).collect())
    starts = F.split(F.lit(",".join(str(first.get(b, 0)) for b in range(buckets))), ",").cast("array<bigint>")
    in_bucket = rank - F.get(starts, F.col("__bucket").cast("int")) + 1
    return written.select(*df.columns, (F.shiftleft("__bucket", ROW_BITS) + in_bucket).alias(out))
