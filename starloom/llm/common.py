"""Pieces that several of the training-data operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from starloom.session import new_scratch

SLICE_BYTES = 1 << 21


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame) -> DataFrame:
    """The same rows, read from a table written below spark.checkpoint.dir.

    It cuts the lineage, survives the loss of executors, and lets Spark delete
    the shuffle files behind it.
    """
    spark = df.sparkSession
    # Shuffle files of a finished query are of no further use; without this
    # they stay until the driver happens to collect its garbage.
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
    path = new_scratch(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_of(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def row_key() -> Column:
    """Names a document: equal only for rows of the same doc_id and text."""
    return F.xxhash64(F.col("doc_id").cast("long"), text_of())


# --- texts as bytes ----------------------------------------------------------


def text_slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that their texts stay near ``limit`` bytes.

    A text is never cut: one that is longer makes a slice of its own.
    """
    for batch in batches:
        _, offsets = column_bytes(batch.column(column))
        start = 0
        while start < batch.num_rows:
            end = int(np.searchsorted(offsets, offsets[start] + limit, side="right")) - 1
            end = min(max(end, start + 1), batch.num_rows)
            yield batch.slice(start, end - start)
            start = end


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and where each row starts; null is empty."""
    if column.null_count:
        column = column.fill_null("")
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or at[-1] == at[0]:
        return np.zeros(0, np.uint8), at - at[0]
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def _bytes_table(*ranges: tuple[int, int]) -> np.ndarray:
    out = np.zeros(256, bool)
    for low, high in ranges:
        out[low : high + 1] = True
    return out


# White space of the contract: a blank, and tab to carriage return.
SPACE = _bytes_table((0x20, 0x20), (0x09, 0x0D))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20

_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE_CODE = np.random.Generator(np.random.PCG64(20)).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1), modulo 2 ** 64."""
    known = _powers.get(base)
    if known is None or len(known) < n:
        factors = np.full(max(n, SLICE_BYTES + 65536), base, np.uint64)
        factors[0] = 1
        known = np.cumprod(factors, dtype=np.uint64)
        if len(known) <= 4 * SLICE_BYTES:
            _powers[base] = known
    return known[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Running polynomial sums, from which the hash of any span follows."""
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE_CODE[data] * _power(_BASE, len(data)), out=sums[1:])
    return sums


def span_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes, equal for equal bytes anywhere."""
    return starting_hashes(sums, starts)(ends)


def starting_hashes(sums: np.ndarray, starts: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
    """``span_hash`` for several ends of the same starts."""
    shift, before = _power(_BASE_INVERSE, len(sums))[starts], sums[starts]
    return lambda ends: mix((sums[ends] - before) * shift)


def word_spans(
    data: np.ndarray, offsets: np.ndarray, between: np.ndarray = SPACE
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and for each text the number of words before it."""
    inside = np.zeros(len(data) + 1, bool)
    inside[:-1] = ~between[data]
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    starts = np.flatnonzero(inside[:-1] & (first[:-1] | ~np.concatenate(([False], inside[: len(data)][:-1]))[: len(data)]))
    ends = np.flatnonzero(inside[:-1] & (first[1:] | ~inside[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


# --- connected components ----------------------------------------------------


class Forest:
    """Union-find over hashable names; the smaller name becomes the root."""

    def __init__(self):
        self.parent = {}

    def find(self, x):
        parent = self.parent
        root = x
        while (up := parent.get(root, root)) != root:
            root = up
        while x != root:
            parent[x], x = root, parent.get(x, x)
        return root

    def union(self, a, b) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        if b < a:
            a, b = b, a
        self.parent[b] = a
        return True


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stars in place of the edges of each batch."""
    for batch in batches:
        forest = Forest()
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            forest.union(a, b)
        nodes = [x for x in forest.parent if forest.find(x) != x]
        yield pa.RecordBatch.from_arrays(
            [pa.array(nodes, pa.int64()), pa.array([forest.find(x) for x in nodes], pa.int64())], ["u", "v"]
        )


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the undirected edges (a, b) but the roots.

    Alternating large-star and small-star steps; each round is written, so the
    lineage stays short. A root is the smallest node of its component.
    """
    pairs = edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a <> b")
    stars = written(pairs.mapInArrow(_contract, "u long, v long").distinct())
    before = None
    while True:
        mark = stars.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(mark) == before or not mark[0]:
            return stars.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = tuple(mark)
        both = stars.unionAll(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lowest, "u").select(
            F.explode(
                F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))
            ).alias("e")
        )
        stars = written(small.select("e.u", "e.v").where("u <> v").distinct())
