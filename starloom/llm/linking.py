"""Connected groups of near-equal members, found without comparing every pair.

A screen names candidates: edges such that members that link lie in one
connected candidate group. Each group then meets in bounded blocks, where a
join looks for links between members that are not connected yet.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain, combinations, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starloom.llm.common import Forest, components, written

# Weight (shingles, characters) that one task joins at once.
BLOCK_WEIGHT = 2_000_000
PIVOTS = 64
SHORT_RUN = 48

# nodes, labels, rows of the payload -> pairs of nodes that link
BlockJoin = Callable[[list[int], list[int], pa.Table], list[tuple[int, int]]]


def runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables of the rows with one key each, from batches sorted by the key."""
    pending, last = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1), len(keys)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if pending and keys[a] != last:
                yield pa.Table.from_batches(pending)
                pending = []
            pending.append(batch.slice(a, b - a))
            last = keys[a]
    if pending:
        yield pa.Table.from_batches(pending)


def near_clusters(
    items: Iterator[tuple], near: Callable[[object, object], int], known: Forest
) -> Iterator[tuple[int, int]]:
    """Edges that connect all items of a run that might link, but for what ``known`` connects.

    items: (node, sketch). near: 2 if the sketches allow a link, 1 if both may
    link to a third, 0 if neither, -1 if the first is of no further use. Items
    join the leaders that they may link to; leaders that may share a link are
    connected, so only leaders are kept. In a short run all pairs are held
    against each other instead.
    """
    head = list(islice(items, SHORT_RUN + 1))
    if len(head) <= SHORT_RUN:
        for (a, x), (b, y) in combinations(head, 2):
            if near(x, y) == 2 and known.union(a, b):
                yield a, b
        return
    items = chain(head, items)
    leaders: list[tuple] = []
    for item in items:
        joined, stale = False, False
        for leader in leaders:
            how = near(leader[1], item[1])
            joined |= how == 2
            stale |= how < 0
            if how > 0 and known.union(leader[0], item[0]):
                yield leader[0], item[0]
        if stale:
            leaders = [x for x in leaders if near(x[1], item[1]) >= 0]
        if not joined:
            leaders.append(item)


def _joined(rows: DataFrame, join: BlockJoin) -> DataFrame:
    """Links that ``join`` finds among the rows of each key ``g``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in runs(batches, "g"):
            if group.num_rows > 1:
                links = join(group["node"].to_pylist(), group["label"].to_pylist(), group)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x for x, _ in links], pa.int64()), pa.array([y for _, y in links], pa.int64())], ["a", "b"]
                )

    return rows.repartition("g").sortWithinPartitions("g").mapInArrow(run, "a long, b long")


def _labelled(members: DataFrame, links: DataFrame) -> DataFrame:
    known = components(links).withColumnRenamed("root", "known")
    return members.drop("label").join(known, "node", "left").withColumn("label", F.coalesce("known", "node")).drop("known")


def link_groups(
    edges: DataFrame,
    members_of: Callable[[DataFrame], DataFrame],
    join: BlockJoin,
    block_weight: int = BLOCK_WEIGHT,
) -> DataFrame:
    """Links (a, b) that connect exactly the members which true links connect.

    edges: candidate edges (a, b). members_of: adds weight and payload to the
    candidate rows (node, root). A group heavier than ``block_weight`` is dealt
    over blocks by hash: first each block is joined, then some pivots with every
    block, and where more than one component is left all pairs of blocks. The
    last is needed only where a heavy group does not hold together.
    """
    stars = components(edges)
    nodes = stars.unionAll(stars.select(F.col("root").alias("node"), "root").distinct())
    members = members_of(nodes)
    weights = members.groupBy("root").agg(
        F.count("*").alias("n_members"), F.ceil(F.sum("weight") / F.lit(block_weight)).cast("int").alias("n_blocks")
    )
    # A row of each node, with its payload.
    members = written(members.join(weights, "root").withColumn("block", F.pmod(F.xxhash64("node"), F.col("n_blocks")).cast("int")))
    first = members.withColumn("label", F.col("node")).withColumn("g", F.xxhash64("root", "block"))
    links = written(_joined(first, join))
    heavy = members.where("n_blocks > 1")
    if heavy.isEmpty():
        return links
    rounds = (
        lambda rows: rows.withColumn(
            "other",
            F.explode(
                F.when(
                    F.pmod(F.xxhash64("node", F.lit(1)), F.ceil(F.col("n_members") / F.lit(PIVOTS))) == 0,
                    F.sequence(F.lit(0), F.col("n_blocks") - 1),
                ).otherwise(F.array("block"))
            ),
        ).withColumn("g", F.xxhash64("root", "other")),
        lambda rows: rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)))
        .where("other <> block")
        .withColumn("g", F.xxhash64("root", F.least("block", "other"), F.greatest("block", "other"))),
    )
    for deal in rounds:
        rows = _labelled(heavy, links)
        apart = rows.groupBy("root").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y").select("root")
        more = written(_joined(deal(rows.join(apart, "root", "left_semi")), join))
        links = links.unionAll(more)
    return links
