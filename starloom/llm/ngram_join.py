"""N-gram Jaccard join: near-equal documents by a prefix tree over ordered n-gram sets."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starloom.llm.common import Forest, LOWER, column_bytes, components, mix, prefix_sums, row_key, span_hash, text_slices, word_spans, written
from starloom.llm.linking import BLOCK_WEIGHT, link_groups, near_clusters, runs

ORDER_BITS = 18
# Connections that a task remembers, so as not to name them again.
MOST_KNOWN = 500_000
_LOW = np.uint64((1 << (64 - ORDER_BITS)) - 1)


class Jaccard(NamedTuple):
    """Sets of ``words``-word shingles link when down * intersection >= up * union."""

    words: int = 5
    up: int = 80
    down: int = 100

    def link(self, n: int, m: int, common: int) -> bool:
        return self.down * common >= self.up * (n + m - common)

    def least_common(self, n: int, m: int) -> int:
        return -(-self.up * (n + m) // (self.up + self.down))

    def prefix(self, n: int) -> int:
        """A partner shares one of the first so many n-grams; 0 if only an equal set can link."""
        return n + (self.up * n) // -self.down + 1 if self.down * n >= self.up * (n + 1) else 0


def shingle_sets(column: pa.Array, words: int) -> Iterator[np.ndarray]:
    """The distinct shingles of each text as sorted 64-bit hashes.

    A text with fewer words is one shingle, its whole sequence; one without
    words has none.
    """
    data, offsets = column_bytes(column)
    data = LOWER[data]
    starts, ends, first = word_spans(data, offsets)
    h = span_hash(prefix_sums(data), starts, ends)
    rolled = np.zeros(max(0, len(h) - words + 1), np.uint64)
    for k in range(words):
        rolled = mix(rolled + h[k : k + len(rolled)]) + np.uint64(2 * k + 1)
    rolled = mix(rolled)
    for a, b in zip(first[:-1], first[1:], strict=True):
        if b - a >= words:
            yield np.unique(rolled[a : b - words + 1])
        elif b > a:
            one = np.uint64(b - a)
            for w in h[a:b].reshape(-1, 1):
                one = mix(w + one)
            yield np.asarray(one, np.uint64).reshape(1)
        else:
            yield np.zeros(0, np.uint64)


def _set_id(grams: np.ndarray) -> int:
    return int(mix(np.array([mix(grams ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum() + np.uint64(len(grams))], np.uint64)).view(np.int64)[0])


def sketch(grams: np.ndarray) -> bytes:
    """Parity of the n-grams in each of 2n or more bits (64 to 4096, a power of two).

    Two sketches differ in no more bits than their sets differ in members.
    """
    bits = min(max(64, 1 << (2 * len(grams) - 1).bit_length()), 4096)
    odd = np.bincount((grams & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def _sets(docs: DataFrame, rule: Jaccard) -> DataFrame:
    """(doc_id, n, sid, sketch) of each document, and rows of n-gram counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << ORDER_BITS, np.int64)
        for batch in text_slices(batches):
            n, ids, marks = [], [], []
            found = list(shingle_sets(batch.column("text"), rule.words))
            for grams in found:
                n.append(len(grams))
                ids.append(_set_id(grams) if len(grams) else None)
                marks.append(sketch(grams) if rule.prefix(len(grams)) else None)
            counts += np.bincount((np.concatenate(found) >> np.uint64(64 - ORDER_BITS)).astype(np.int64), minlength=len(counts))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("doc"),
                    pa.array(n, pa.int64()),
                    pa.array(ids, pa.int64()),
                    pa.array(marks, pa.binary()),
                    pa.nulls(len(n), pa.binary()),
                ],
                ["doc_id", "doc", "n", "sid", "sketch", "counts"],
            )
        if counts.any():
            packed = zlib.compress(counts.tobytes(), 1)
            columns = [pa.nulls(1, pa.int64())] * 4 + [pa.nulls(1, pa.binary()), pa.array([packed], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "doc", "n", "sid", "sketch", "counts"])

    return docs.select(F.col("doc_id").cast("long"), row_key().alias("doc"), "text").mapInArrow(
        run, "doc_id long, doc long, n long, sid long, sketch binary, counts binary"
    )


def _global_order(rows: DataFrame) -> np.ndarray:
    """Rank of each n-gram bucket, the rarest first; counts cover all documents."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for packed in batch.column(0).to_pylist():
                counts = np.frombuffer(zlib.decompress(packed), np.int64)
                own = np.flatnonzero(counts)
                yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), pa.array(counts[own])], ["bucket", "n"])

    spreads = rows.where("counts IS NOT NULL").select("counts").mapInArrow(spread, "bucket int, n long")
    sums = spreads.groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()  # 2 ** ORDER_BITS rows at most
    counts = np.zeros(1 << ORDER_BITS, np.int64)
    counts[sums["bucket"].to_numpy()] = sums["n"].to_numpy()
    rank = np.empty(len(counts), np.uint64)
    rank[np.argsort(counts, kind="stable")] = np.arange(len(counts), dtype=np.uint64)
    return rank


def ordered(grams: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """N-grams renamed so that their numeric order is the global order."""
    top = np.uint64(64 - ORDER_BITS)
    return np.sort((rank[(grams >> top).astype(np.int64)] << top) | (grams & _LOW))


def _prefixes(docs: DataFrame, rank, rule: Jaccard) -> DataFrame:
    """(gram, sid, n) for the rarest n-grams of each set, as many as a partner cannot miss."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            grams, ids, sizes = [], [], []
            for own in {_set_id(g): g for g in shingle_sets(batch.column("text"), rule.words) if len(g)}.items():
                length = rule.prefix(len(own[1]))
                if length:
                    grams.append(ordered(own[1], rank.value)[:length].view(np.int64))
                    ids.append(np.full(length, own[0], np.int64))
                    sizes.append(np.full(length, len(own[1]), np.int32))
            if grams:
                columns = [pa.array(np.concatenate(x)) for x in (grams, ids, sizes)]
                yield pa.RecordBatch.from_arrays(columns, ["gram", "sid", "n"])

    return docs.select("text").mapInArrow(run, "gram long, sid long, n int")


def _shared(prefixes: DataFrame) -> DataFrame:
    """Prefix n-grams of two sets or more; of n-grams with the same sets one is kept."""
    dealt = prefixes.repartition("gram").dropDuplicates(["gram", "sid"])
    lists = dealt.groupBy("gram").agg(
        F.min("sid").alias("low"),
        F.max("sid").alias("high"),
        F.count("*").alias("size"),
        F.sum(F.xxhash64("sid").cast("decimal(20,0)")).alias("mark"),
    )
    alone = lists.where("low <> high")
    both = written(dealt.join(alone, "gram").select("gram", "sid", "n", "size", "mark"))
    one = both.groupBy("size", "mark").agg(F.min("gram").alias("gram")).select("gram")
    return both.select("gram", "sid", "n").join(one, "gram", "left_semi")


def _near(rule: Jaccard):
    """How two sketches bear on a link; the second set is the larger one."""

    def near(a: tuple[int, int, int], b: tuple[int, int, int]) -> int:
        (n, bits, x), (m, bits_b, y) = a, b
        if n * rule.down * rule.down < m * rule.up * rule.up:
            return -1
        while bits_b > bits:
            bits_b //= 2
            y = (y >> bits_b) ^ (y & ((1 << bits_b) - 1))
        apart = (x ^ y).bit_count()
        # Linked sets n <= m differ in m + n - 2 * least_common members at most.
        if n * rule.down >= m * rule.up and apart <= n + m - 2 * rule.least_common(n, m):
            return 2
        most = m * rule.down // rule.up
        return int(apart <= 2 * (m + most - 2 * rule.least_common(m, most)))

    return near


def _screen(shared: DataFrame, sets: DataFrame, rule: Jaccard) -> DataFrame:
    """Edges between sets of a common prefix n-gram that may link by size and sketch."""
    near = _near(rule)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Forest()
        for group in runs(batches, "gram"):
            if len(known.parent) > MOST_KNOWN:
                known = Forest()
            if group.num_rows < 2:
                continue
            items = (
                (s, (n, 8 * len(k), int.from_bytes(k, "little")))
                for s, n, k in zip(group["sid"].to_pylist(), group["n"].to_pylist(), group["sketch"].to_pylist(), strict=True)
            )
            edges = list(near_clusters(items, near, known))
            if edges:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*edges, strict=True)], ["a", "b"])

    rows = shared.join(sets.select("sid", "sketch"), "sid")
    return rows.repartition("gram").sortWithinPartitions("gram", "n", "sid").mapInArrow(run, "a long, b long").distinct()


class PrefixTree:
    """A compressed trie over sets in the global order, the most frequent n-gram of the corpus first.

    The sets hold n-grams renamed by ``ordered``, whose numbers rise with their frequency.
    """

    def __init__(self, sets: list[np.ndarray]):
        grams, places = np.unique(np.concatenate(sets), return_inverse=True)
        places = len(grams) - 1 - places
        bounds = np.concatenate(([0], np.cumsum([len(s) for s in sets])))
        paths = [np.sort(places[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        # Sorted paths put each subtree's sets next to one another.
        self.order = sorted(range(len(sets)), key=lambda i: paths[i].astype(">u4").tobytes())
        self.paths = [paths[i] for i in self.order]
        self.sizes = np.array([len(p) for p in self.paths])
        self.n_grams = len(grams)
        shared = [0] + [self._common(a, b) for a, b in zip(self.paths, self.paths[1:], strict=False)]
        self.root = self._build(np.array(shared))

    @staticmethod
    def _common(a: np.ndarray, b: np.ndarray) -> int:
        n = min(len(a), len(b))
        apart = a[:n] != b[:n]
        return int(apart.argmax()) if apart.any() else n

    def _build(self, shared: np.ndarray) -> tuple:
        """Nodes (first set, last set + 1, edge, depth at its end, least and most set size, children)."""
        root = (0, len(self.paths), self.paths[0][:0], 0, int(self.sizes.min()), int(self.sizes.max()), [])
        todo = [root]
        while todo:
            low, high, _, depth, _, _, children = todo.pop()
            start = low + (len(self.paths[low]) == depth and depth > 0)
            cuts = [start, *(start + 1 + np.flatnonzero(shared[start + 1 : high] <= depth)), high] if start < high else []
            for a, b in zip(cuts, cuts[1:], strict=False):
                end = int(shared[a + 1 : b].min()) if b - a > 1 else len(self.paths[a])
                sizes = self.sizes[a:b]
                node = (a, b, self.paths[a][depth:end], end, int(sizes.min()), int(sizes.max()), [])
                children.append(node)
                if b - a > 1:
                    todo.append(node)
        return root

    def links(self, labels: list[int], rule: Jaccard) -> list[tuple[int, int]]:
        """Pairs of sets that link and that labels and earlier pairs do not connect.

        Each set walks the tree once. Sets below a node share the overlap counted
        on the way to it; a subtree is left when what remains of either side
        cannot make up the least overlap, or when all of it is connected already.
        """
        label = np.array([labels[i] for i in self.order])
        inside, out = np.zeros(self.n_grams, bool), []
        for q, path in enumerate(self.paths):
            n = len(path)
            inside[path] = True
            todo = [(child, 0) for child in self.root[6]]
            while todo:
                (low, high, edge, depth, least, most, children), overlap = todo.pop()
                high = min(high, q)
                if low >= high or most * rule.down < n * rule.up or n * rule.down < least * rule.up:
                    continue
                if (label[low:high] == label[q]).all():
                    continue
                overlap += int(np.count_nonzero(inside[edge]))
                left = n - int(np.searchsorted(path, edge[-1], "right")) if len(edge) else n
                size = max(least, -(-n * rule.up // rule.down))
                if overlap + min(left, most - depth) < rule.least_common(n, size):
                    continue
                if len(self.paths[low]) == depth and label[low] != label[q] and rule.link(n, depth, overlap):
                    out.append((self.order[low], self.order[q]))
                    label[label == label[low]] = label[q]
                todo.extend((child, overlap) for child in children)
            inside[path] = False
        return out


def _rooted(given: DataFrame, rule: Jaccard, block_weight: int) -> DataFrame:
    """(doc_id, doc, n, root) of each row of given (doc_id, text); root is null without shingles."""
    rows = written(_sets(given, rule))
    sets = rows.where("counts IS NULL").select("doc_id", "doc", "n", "sid", "sketch")
    rank = given.sparkSession.sparkContext.broadcast(_global_order(rows))
    classes = sets.where("sketch IS NOT NULL").groupBy("sid").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "doc")).alias("first"),
        F.min("n").alias("weight"),
        F.first("sketch").alias("sketch"),
    )
    classes = classes.select("sid", F.col("first.doc").alias("rep"), "weight", "sketch")
    edges = _screen(_shared(_prefixes(given, rank, rule)), classes, rule)

    def members_of(nodes: DataFrame) -> DataFrame:
        # By the row's key, which null ids have too; of rows alike one is read.
        one = nodes.join(classes.drop("sketch"), nodes["node"] == classes["sid"]).drop("sid")
        keyed = given.select(row_key().alias("rep"), "text").join(one.select("rep"), "rep", "left_semi").dropDuplicates(["rep"])
        return one.join(keyed, "rep").drop("rep")

    def join(nodes: list[int], labels: list[int], payload: pa.Table) -> list[tuple[int, int]]:
        found: dict[int, tuple[int, np.ndarray]] = {}
        wanted = dict(zip(nodes, labels, strict=True))
        for batch in text_slices(payload.to_batches()):
            for grams in shingle_sets(batch.column("text"), rule.words):
                own = _set_id(grams) if len(grams) else None
                if own in wanted:  # a repeated id may bring other texts along
                    found[own] = (wanted[own], ordered(grams, rank.value))
        ids = list(found)
        if len(ids) < 2:
            return []
        links = PrefixTree([found[i][1] for i in ids]).links([found[i][0] for i in ids], rule)
        return [(ids[a], ids[b]) for a, b in links]

    roots = components(link_groups(edges, members_of, join, block_weight))
    return sets.join(roots.withColumnRenamed("node", "sid"), "sid", "left").select(
        "doc_id", "doc", "n", F.coalesce("root", "sid").alias("root")
    )


def ngram_components(
    docs: DataFrame,
    rule: Jaccard = Jaccard(),
    doc_id: str = "doc_id",
    text: str = "text",
    block_weight: int = BLOCK_WEIGHT,
) -> DataFrame:
    """(doc_id, n_shingles, component_id): documents that links of equal or near n-gram sets connect.

    Words are what white space separates, A-Z in lower case. Documents with the
    same set share one node, so copies are never paired. The rarest n-grams of
    each set name candidates, parity sketches drop those whose sets must differ
    too much, and a prefix tree over each candidate group finds the links. No
    link between different sets is lost; n-grams and sets are told apart by
    64-bit hashes.

    component_id is the smallest doc_id that links reach. A null or empty text
    has no shingle and links with nothing: its component is its own id. A null
    id keeps its row, may be linked, and never names a component that has
    another id. Repeated rows come back each. Other columns are not read.
    """
    given = docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].alias("text"))
    named = _rooted(given, rule, block_weight)
    least = named.where("root IS NOT NULL").groupBy("root").agg(F.min("doc_id").alias("least"))
    return named.join(least, "root", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("least", "doc_id").alias("component_id")
    )


def keep_one(docs: DataFrame, rule: Jaccard = Jaccard(), block_weight: int = BLOCK_WEIGHT) -> DataFrame:
    """One row of each component, that of the smallest id (a null id last).

    Of rows alike in id and text one stays. Documents without words are kept,
    all of them: nothing shows that they repeat another.
    """
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    named = _rooted(given, rule, block_weight).where("root IS NOT NULL")
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "doc")
    kept = named.groupBy("root").agg(F.min(order).alias("first")).select(F.col("first.doc").alias("__doc"))
    has_words = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    keyed = docs.where(has_words).withColumn("__doc", row_key())
    once = keyed.join(kept, "__doc", "left_semi").dropDuplicates(["__doc"]).drop("__doc")
    return once.unionByName(docs.where(~has_words))
