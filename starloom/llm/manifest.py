"""Merkle dataset manifest: hash trees over the rows of each group, built by sibling-shift self-joins."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from starloom.llm.common import written

# Fixed value: Spark's row ids hold the partition above 33 bits of row number.
ROW_BITS = 33
# A path is gathered over so many levels at a time, so what is shuffled does not grow with the height.
STRIDE = 8
EMPTY_PATH = "cast(array() as array<array<binary>>)"


def _hash(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def _text(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def _joined(digests: Column) -> Column:
    """Digests as hex text, one after the other; missing ones are left out."""
    return F.array_join(F.transform(digests, _text), "")


def leaf_digest(*fields: Column) -> Column:
    """Digest of a row: each field framed by its UTF-8 byte count, ``-`` for null."""
    texts = [f.cast("string") for f in fields]
    framed = [F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]
    return _hash(F.concat(*framed))


def _parent(index: Column, arity: int) -> Column:
    return ((index - index % arity) / arity).cast("long")


def _positions(rows: DataFrame, order: Sequence[str], group: str | None = None) -> DataFrame:
    """Adds ``idx``, the place of a row in its group by ``order``, and ``n``, the group's rows.

    No window over a group: a range shuffle sorts all rows, each keeps its
    partition and place there, and what lies before is a sum over one row per
    group and partition. Nothing of it comes to the driver.
    """
    keys = [group] if group else []
    ascending = [F.col(c).asc_nulls_first() for c in (*keys, *order)]
    placed = written(
        rows.repartitionByRange(*ascending).sortWithinPartitions(*ascending).withColumn("at", F.monotonically_increasing_id())
    ).withColumn("part", F.shiftright("at", ROW_BITS))
    held = F.struct(*keys) if group else F.lit(0)
    parts = placed.groupBy(held.alias("own"), "part").agg(F.count("*").alias("rows"), F.min("at").alias("first"))
    before = Window.partitionBy("own").orderBy("part")
    parts = parts.select(
        "own",
        "part",
        (F.sum("rows").over(before) - F.col("rows") - F.col("first")).alias("shift"),
        F.sum("rows").over(Window.partitionBy("own")).alias("n"),
    )
    placed = placed.withColumn("own", held)
    return (
        placed.join(parts, ["own", "part"])
        .withColumn("idx", F.col("at") + F.col("shift"))
        .select(*rows.columns, "idx", "n")
    )


def with_siblings(nodes: DataFrame, arity: int) -> DataFrame:
    """Adds ``others``: the digests of a node's siblings, left to right, null where there is none.

    The siblings come by equijoins of the level with itself, at computed
    indices: the flipped lowest bit where runs are pairs, else each offset
    around the slots of a run.
    """
    index = F.col("idx")
    shifted = nodes.select("tree", "idx", "digest")
    if arity == 2:
        twin = shifted.select("tree", index.bitwiseXOR(F.lit(1)).alias("idx"), F.col("digest").alias("twin"))
        return nodes.join(twin, ["tree", "idx"], "left").withColumn("others", F.array("twin")).drop("twin")
    slot = index % arity
    out, offsets = nodes, range(1, arity)
    for offset in offsets:
        at = index - slot + F.pmod(slot - offset, F.lit(arity))
        out = out.join(shifted.select("tree", at.alias("idx"), F.col("digest").alias(f"next_{offset}")), ["tree", "idx"], "left")
    around = F.array(*[f"next_{offset}" for offset in offsets])
    slots = F.filter(F.sequence(F.lit(0), F.lit(arity - 1)), lambda t: t != slot)
    others = F.transform(slots, lambda t: F.get(around, (F.pmod(t - slot, F.lit(arity)) - 1).cast("int")))
    return out.withColumn("others", others).drop(*[f"next_{offset}" for offset in offsets])


def _climb(nodes: DataFrame, arity: int, most: int) -> list[DataFrame]:
    """The levels from the leaves up, each written; ``most`` is the number of leaves of the largest tree."""
    levels = []
    while True:
        levels.append(written(with_siblings(nodes, arity)))
        if most <= 1:
            return levels
        most = -(-most // arity)
        first = levels[-1].where((F.col("n") > 1) & (F.col("idx") % arity == 0))
        nodes = first.select(
            "tree",
            _parent(F.col("idx"), arity).alias("idx"),
            F.ceil(F.col("n") / arity).alias("n"),
            _hash(F.concat(_text(F.col("digest")), _joined(F.col("others")))).alias("digest"),
        )


def _roots(levels: list[DataFrame]) -> DataFrame:
    """(tree, digest) of the node that remains of each tree."""
    ends = [level.where("n = 1").select("tree", "digest") for level in levels]
    out = ends[0]
    for end in ends[1:]:
        out = out.unionAll(end)
    return out


def _paths(levels: list[DataFrame], arity: int) -> DataFrame:
    """The leaves with ``path``: the siblings of each level up to the root of the tree.

    From the top down, a node takes its parent's path. It is gathered over a
    stride of levels, and what lies above the stride is joined once for all of it.
    """
    above = None
    for low in reversed(range(0, len(levels), STRIDE)):
        here = None
        for level in reversed(levels[low : low + STRIDE]):
            own = level.withColumn("path", F.when(F.col("n") > 1, F.array("others")).otherwise(F.expr(EMPTY_PATH)))
            here = own if here is None else _with_path_above(own, here, arity)
        if above is not None:
            here = _with_path_above(here, above, arity**STRIDE)
        above = written(here.select("tree", "idx", "path")) if low else here
    return above


def _with_path_above(own: DataFrame, above: DataFrame, below: int) -> DataFrame:
    above = above.select("tree", F.col("idx").alias("up"), F.col("path").alias("rest"))
    return (
        own.withColumn("up", _parent(F.col("idx"), below))
        .join(above, ["tree", "up"], "left")
        .withColumn("path", F.concat("path", F.coalesce("rest", F.expr(EMPTY_PATH))))
        .drop("up", "rest")
    )


def merkle_manifest(
    docs: DataFrame,
    digest: Column,
    group: str = "lang",
    order: str = "doc_id",
    arity: int = 2,
    also: Mapping[str, Column] | None = None,
) -> DataFrame:
    """One row per document with its leaf and the proof that it belongs to the data set.

    The leaves of a group ascend by ``order`` (null first; ties by digest, rows
    alike in all are interchangeable). While several nodes remain, each run of
    ``arity`` becomes the digest of its digests; the last run may be shorter,
    also a single node. The roots of the groups, ordered by group (null
    first, then by UTF-8 bytes), make one more tree in the same way.

    Returns ``group``, ``order``, the columns ``also`` (made from ``docs``), and
    tree, idx (the place of the group and of the leaf in it, from 0), n, digest,
    subroot, root (binary), path and top_path: for each level up to the
    subroot and to the root an array of the ``arity`` - 1 siblings, left to right,
    null where the run is short. Other columns of ``docs`` are not carried, so
    none clashes. Nulls are values of their own; no document gives no row.
    """
    also = {name: also[name] for name in also or {}}
    rows = written(
        docs.select(
            F.col(group).alias("group"),
            F.col(order).alias("order"),
            digest.alias("digest"),
            *[column.alias(f"also_{name}") for name, column in also.items()],
            # Rows alike in all else still spread over range partitions.
            F.monotonically_increasing_id().alias("row"),
        )
    )
    placed = written(_positions(rows, ["order", "digest", "row"], "group").drop("row"))
    groups = placed.groupBy("group").agg(F.max("n").alias("leaves"))
    trees = written(_positions(groups, ["group"]).select("group", "leaves", F.col("idx").alias("tree"), F.col("n").alias("n_trees")))
    most_leaves, n_trees = trees.agg(F.max("leaves"), F.max("n_trees")).first()
    if not n_trees:
        most_leaves = n_trees = 0

    numbered = trees.select(F.struct("group").alias("own"), "tree")
    leaves = placed.withColumn("own", F.struct("group")).join(numbered, "own").drop("own")
    levels = _climb(leaves, arity, most_leaves)
    tops = _roots(levels).join(trees.select("tree", "n_trees"), "tree")
    top_levels = _climb(
        tops.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("idx"), F.col("n_trees").alias("n"), "digest"),
        arity,
        n_trees,
    )
    last = _roots(top_levels).first()
    root = F.unhex(F.lit(last.digest.hex() if last else None).cast("string"))
    tops = _paths(top_levels, arity).select(
        F.col("idx").alias("tree"), F.col("digest").alias("subroot"), F.col("path").alias("top_path")
    )
    out = _paths(levels, arity).join(tops, "tree")
    return out.select(
        F.col("group").alias(group),
        F.col("order").alias(order),
        *[F.col(f"also_{name}").alias(name) for name in also],
        "tree",
        "idx",
        "n",
        "digest",
        "subroot",
        root.alias("root"),
        "path",
        "top_path",
    )


def proof_siblings(path: str = "path", top_path: str = "top_path") -> Column:
    """The siblings of a leaf's proof as hex text, level by level, left to right."""
    return _joined(F.flatten(F.concat(path, top_path)))


def _fold(start: Column, at: Column, path: Column, arity: int) -> Column:
    def up(node: Column, others: Column) -> Column:
        slot = (node["at"] % arity).cast("int")
        left, right = F.slice(others, 1, slot), F.slice(others, slot + 1, arity - 1)
        run = F.concat(left, F.array(node["digest"]), right)
        return F.struct(_hash(_joined(run)).alias("digest"), _parent(node["at"], arity).alias("at"))

    return F.aggregate(path, F.struct(start.alias("digest"), at.alias("at")), up)["digest"]


def folded_root(leaf: Column, arity: int = 2) -> Column:
    """The root that a claimed leaf digest and the siblings of a row of the manifest lead to."""
    subroot = _fold(leaf, F.col("idx"), F.col("path"), arity)
    return _fold(subroot, F.col("tree"), F.col("top_path"), arity)


def hex_text(digest: str) -> Column:
    return _text(F.col(digest))
