"""Fuzzy line deduplication: SimHash, pigeonhole blocks, edit similarity, one line of each group."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starloom.llm.common import Forest, column_bytes, components, mix, prefix_sums, row_key, span_hash, text_slices, word_spans, written
from starloom.llm.editing import edit_distance
from starloom.llm.linking import BLOCK_WEIGHT, link_groups, near_clusters, runs


# Parts of a line of which one may be edited at will.
PARTS = 3


class LineRule(NamedTuple):
    """Lines of ``least_words`` words or more link when their edit similarity is ``up`` / ``down`` or more.

    Only candidates are compared: lines of which at most ``bits`` of the 64 SimHash bits
    differ, so that two of ``blocks`` blocks of these bits agree, and lines that
    agree in all words but those of one part.
    """

    least_words: int = 5
    bits: int = 2
    blocks: int = 4
    up: int = 80
    down: int = 100

    def similar(self, a: str, b: str) -> bool:
        longest = max(len(a), len(b))
        if self.down * abs(len(a) - len(b)) > (self.down - self.up) * longest:
            return False
        return self.down * edit_distance(a, b) <= (self.down - self.up) * longest


# Normal form: lower case, digits alike, words apart from signs and white space.
_NORMAL = np.arange(256, dtype=np.uint8)
_NORMAL[0x30:0x3A] = 0x30
_BETWEEN = np.zeros(256, bool)
_BETWEEN[:0x80] = True
_BETWEEN[0x61:0x7B] = _BETWEEN[0x30:0x3A] = False
_NEWLINE = 0x0A


class Lines(NamedTuple):
    """Lines with enough words: the text and line they are in, their key, SimHash, keys without a part, and words."""

    text: np.ndarray
    line: np.ndarray
    key: np.ndarray
    sim: np.ndarray
    parts: np.ndarray
    first_word: np.ndarray
    last_word: np.ndarray


def _normal(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    data, offsets = column_bytes(pc.utf8_lower(column.fill_null("")))
    return _NORMAL[data], offsets


def find_lines(data: np.ndarray, offsets: np.ndarray, rule: LineRule) -> tuple[Lines, np.ndarray, np.ndarray]:
    """The lines of normalised texts, and where the words start and end."""
    starts, ends, _ = word_spans(data, offsets, _BETWEEN)
    words = span_hash(prefix_sums(data), starts, ends)
    breaks = np.flatnonzero(data == _NEWLINE) + 1
    begins = np.sort(np.concatenate((offsets[:-1], breaks)), kind="stable")
    # A text that starts where a line break ends has two begins there: the first is the empty line before.
    text = np.searchsorted(offsets[1:], begins, side="right")
    ties = np.flatnonzero(begins[1:] == begins[:-1])
    text = np.minimum(text, len(offsets) - 2)
    order = np.lexsort((begins, text)) if len(ties) else np.arange(len(begins))
    begins, text = begins[order], text[order]
    opens = np.searchsorted(begins, offsets[:-1], side="left")
    line = np.arange(len(begins)) - opens[text] if len(begins) else begins
    low = np.searchsorted(starts, begins)
    high = np.append(low[1:], len(starts))
    own = np.flatnonzero(high - low >= max(1, rule.least_words))
    low, high = low[own], high[own]
    if not len(own):
        none = np.zeros(0, np.int64)
        return Lines(none, none, none, none.view(np.uint64), none.reshape(0, 2 * PARTS), none, none), starts, ends
    lengths = high - low
    at = np.repeat(low - np.concatenate(([0], np.cumsum(lengths)[:-1])), lengths) + np.arange(lengths.sum())
    cuts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    inside = (at - np.repeat(low, lengths)).astype(np.uint64)
    forward = mix(words[at] ^ mix(inside + np.uint64(1)))
    key = mix(np.add.reduceat(forward, cuts) + lengths.astype(np.uint64))
    backward = mix(words[at] ^ mix(np.repeat(lengths, lengths).astype(np.uint64) - inside + _BACKWARD))
    parts = _without_parts(forward, backward, cuts, lengths)
    # Each word votes once: else the commonest words alone would make long lines alike.
    voters, n_voters = _voters(words[at], cuts, lengths)
    votes = _votes(voters, np.concatenate(([0], np.cumsum(n_voters)[:-1])), n_voters)
    sim = np.packbits(votes, axis=1).view("<u8").ravel().astype(np.uint64)
    return Lines(text[own], line[own], key.view(np.int64), sim, parts.view(np.int64), low, high), starts, ends


_BACKWARD = np.uint64(1 << 40)
_WORD_BITS = np.uint64(40)


def _voters(words: np.ndarray, cuts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct words of each line, by 40 bits of their hashes, and how many a line has."""
    found, counts, most = [], [], 1 << 24
    for a in range(0, len(cuts), most):
        size = lengths[a : a + most]
        part = words[cuts[a] : cuts[a] + size.sum()] >> (np.uint64(64) - _WORD_BITS)
        # One sort does: the line stands above the word.
        owned = np.sort(np.repeat(np.arange(len(size), dtype=np.uint64) << _WORD_BITS, size) | part)
        owned = owned[np.concatenate(([True], owned[1:] != owned[:-1]))]
        counts.append(np.bincount((owned >> _WORD_BITS).astype(np.int64), minlength=len(size)))
        found.append(mix(owned & ((np.uint64(1) << _WORD_BITS) - np.uint64(1))))
    return np.concatenate(found), np.concatenate(counts)


def _without_parts(forward: np.ndarray, backward: np.ndarray, cuts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Keys of each line's words but those of one part, for lines of as many words and of one less.

    Lines that differ within one part, where one may have a word more, have a key in common.
    """
    before = np.concatenate((np.zeros(1, np.uint64), np.cumsum(forward, dtype=np.uint64)))
    behind = np.concatenate((np.zeros(1, np.uint64), np.cumsum(backward, dtype=np.uint64)))
    ends, keys = cuts + lengths, []
    for less in (0, 1):
        size = lengths - less
        for part in range(PARTS):
            first, rest = size * part // PARTS, size - size * (part + 1) // PARTS
            head = before[cuts + first] - before[cuts]
            tail = behind[ends] - behind[ends - rest]
            named = mix((size * PARTS + part).astype(np.uint64) + np.uint64(1))
            keys.append(mix(mix(head + named) ^ tail))
    return np.stack(keys, axis=1)


# The bits of a byte, each in a byte of its own: sums of up to 255 words add up in one number.
_LANES = np.array([sum(((b >> (7 - i)) & 1) << (8 * i) for i in range(8)) for b in range(256)], "<u8")


def _votes(words: np.ndarray, cuts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """For each line and bit whether more than half of the words have it."""
    votes = np.empty((len(cuts), 64), bool)
    ends = np.append(cuts[1:], len(words))
    step = 1 << 13
    for a in range(0, len(cuts), step):
        own = slice(a, min(a + step, len(cuts)))
        part = words[cuts[a] : ends[own][-1]].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones = np.add.reduceat(_LANES[part], cuts[own] - cuts[a], axis=0).view(np.uint8).reshape(-1, 64)
        votes[own] = 2 * ones.astype(np.int32) > lengths[own, None]
    for i in np.flatnonzero(lengths > 255):
        bits = np.unpackbits(words[cuts[i] : ends[i]].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1)
        votes[i] = 2 * bits.sum(axis=0, dtype=np.int64) > lengths[i]
    return votes


def _occurrences(docs: DataFrame, rule: LineRule) -> DataFrame:
    """(doc_id, doc, line, key, sim, part_0 ...) of every line with enough words."""
    names = [f"part_{i}" for i in range(2 * PARTS)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            lines, _, _ = find_lines(*_normal(batch.column("text")), rule)
            owner = pa.array(lines.text)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").take(owner),
                    batch.column("doc").take(owner),
                    pa.array(lines.line.astype(np.int32)),
                    pa.array(lines.key),
                    pa.array(lines.sim.view(np.int64)),
                    *[pa.array(np.ascontiguousarray(lines.parts[:, i])) for i in range(2 * PARTS)],
                ],
                ["doc_id", "doc", "line", "key", "sim", *names],
            )

    schema = "doc_id long, doc long, line int, key long, sim long, " + ", ".join(f"{n} long" for n in names)
    return docs.select("doc_id", "doc", "text").mapInArrow(run, schema)


def _block_keys(rule: LineRule):
    """One key for each choice of blocks that must agree when ``bits`` bits differ, even; and those without a part, odd."""
    cuts = [64 * i // rule.blocks for i in range(rule.blocks + 1)]
    masks = [((1 << (b - a)) - 1) << a for a, b in zip(cuts, cuts[1:], strict=False)]
    keys = []
    for n, chosen in enumerate(combinations(masks, rule.blocks - rule.bits)):
        mask = sum(chosen)
        mask -= (1 << 64) if mask >= 1 << 63 else 0
        keys.append(F.xxhash64(F.lit(n), F.col("sim").bitwiseAND(F.lit(mask))).bitwiseAND(F.lit(-2)))
    return F.explode(F.array(*keys, *[F.col(f"part_{i}").bitwiseOR(F.lit(1)) for i in range(2 * PARTS)]))


def _screen(lines: DataFrame, rule: LineRule) -> DataFrame:
    """Edges that connect all lines whose SimHash may link, and those alike but for a part, from the lines of equal block keys."""

    def near(a: int, b: int) -> int:
        apart = (a ^ b).bit_count()
        return 2 if apart <= rule.bits else int(apart <= 2 * rule.bits)

    def alike(a: int, b: int) -> int:
        return 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Forest()
        mask = (1 << 64) - 1
        for batch in _repeated(batches, rule.bits):
            edges = []
            for group in runs(iter([batch]), "block"):
                items = zip(group["key"].to_pylist(), [s & mask for s in group["sim"].to_pylist()], strict=True)
                edges.extend(near_clusters(items, alike if group["block"][0].as_py() & 1 else near, known))
            if len(known.parent) > 500_000:
                known = Forest()
            if edges:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*edges, strict=True)], ["a", "b"])

    blocks = lines.select(_block_keys(rule).alias("block"), "key", "sim")
    return blocks.repartition("block").sortWithinPartitions("block").mapInArrow(run, "a long, b long").distinct()


def _repeated(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """Runs of a block with two lines or more, of which some are near the line before or the run is long."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column("block").to_numpy()
        held.append(batch)
        cut = int(np.searchsorted(keys, keys[-1]))
        if cut == 0 and len(held) > 0:
            continue
        whole = [*held[:-1], batch.slice(0, cut)]
        held = [batch.slice(cut)]
        yield _only_runs(whole, bits)
    if held:
        yield _only_runs(held, bits)


def _only_runs(batches: list[pa.RecordBatch], bits: int) -> pa.RecordBatch:
    table = pa.Table.from_batches(batches).combine_chunks()
    keys = table["block"].to_numpy()
    sims = table["sim"].to_numpy().view(np.uint64)
    same = keys[1:] == keys[:-1]
    before, after = np.concatenate(([False], same)), np.concatenate((same, [False]))
    # Most runs are two lines that share a block by chance.
    pair = after & ~before & ~np.concatenate((after[1:], [False]))
    far = pair.copy()
    places = np.flatnonzero(pair)
    far[places] = (np.bitwise_count(sims[places] ^ sims[places + 1]) > bits) & (keys[places] & 1 == 0)
    drop = far | np.concatenate(([False], far[:-1]))
    kept = table.filter(pa.array((before | after) & ~drop))
    return kept.combine_chunks().to_batches()[0] if kept.num_rows else batches[0].slice(0, 0)


def line_groups(docs: DataFrame, rule: LineRule = LineRule(), block_weight: int = BLOCK_WEIGHT) -> DataFrame:
    """(doc_id, doc, line, kept) of every line with enough words, from docs (doc_id, doc, text).

    Lines that normalise alike are one node, so copies are never paired. Nodes
    that share enough SimHash blocks, or all words but those of one part, are
    candidates; their edit similarity is verified within each candidate group. Of a connected group one occurrence
    is kept, the first by (doc_id, doc, line), a null id last.
    """
    lines = written(_occurrences(docs, rule))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "doc", "line")).alias("first")
    hashes = ["sim", *[f"part_{i}" for i in range(2 * PARTS)]]
    nodes = written(lines.groupBy("key").agg(first, *[F.first(c).alias(c) for c in hashes]))

    def members_of(found: DataFrame) -> DataFrame:
        at = found.join(nodes, found["node"] == nodes["key"]).select("node", "root", "sim", "first.doc", "first.line")
        wanted = at.groupBy("doc").agg(F.collect_list(F.struct("line", "node", "root", "sim")).alias("wanted"))
        texts = docs.select("doc", "text").join(wanted, "doc")
        return texts.mapInArrow(_cut_lines, "node long, root long, sim long, body string, weight long")

    def join(ids: list[int], labels: list[int], payload: pa.Table) -> list[tuple[int, int]]:
        bodies = payload["body"].to_pylist()
        sims, label = payload["sim"].to_numpy().view(np.uint64), np.array(labels)
        letters, sizes = _letters(bodies), np.array([len(b) for b in bodies])
        reach = _reach(np.array([b.count(" ") + 1 for b in bodies]))
        links = []
        for i in range(1, len(ids)):
            near = np.bitwise_count(sims[:i] ^ sims[i]) <= np.maximum(reach[:i], reach[i])
            close = np.flatnonzero(near & (label[:i] != label[i]))
            # An edit changes the counts of letters by two at most.
            apart = np.abs(letters[close] - letters[i]).sum(axis=1) * rule.down
            close = close[apart <= 2 * (rule.down - rule.up) * np.maximum(sizes[close], sizes[i])]
            for j in close.tolist():
                if label[i] != label[j] and rule.similar(bodies[i], bodies[j]):
                    links.append((ids[i], ids[j]))
                    label[label == label[j]] = label[i]
        return links

    roots = components(link_groups(_screen(nodes.select("key", *hashes), rule), members_of, join, block_weight))
    groups = nodes.join(roots.withColumnRenamed("node", "key"), "key", "left").select(
        "key", "first", F.coalesce("root", "key").alias("root")
    )
    firsts = groups.groupBy("root").agg(F.min("first").alias("first"))
    kept = written(groups.select("key", "root").join(firsts, "root").select("key", "first.doc", "first.line"))
    here = kept.select("key", F.col("doc").alias("kept_doc"), F.col("line").alias("kept_line"))
    return lines.join(here, "key").select(
        "doc_id", "doc", "line", ((F.col("doc") == F.col("kept_doc")) & (F.col("line") == F.col("kept_line"))).alias("kept")
    )


def _reach(words: np.ndarray) -> np.ndarray:
    """SimHash bits by which similar lines of so many words may differ: about twice what one other word changes."""
    return np.clip(2 * 64 / np.pi * np.arccos(1 - 1 / np.maximum(words, 2)), 6, 32).astype(np.int64)


def _letters(bodies: list[str]) -> np.ndarray:
    """How often each of 32 classes of characters occurs in each text."""
    out = np.zeros((len(bodies), 32), np.int32)
    for i, body in enumerate(bodies):
        out[i] = np.bincount(np.frombuffer(body.encode("utf-32-le"), np.uint32) & 31, minlength=32)
    return out


def _cut_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The normalised words of the wanted lines of each document."""
    for batch in text_slices(batches):
        rows = []
        for text, wanted in zip(batch.column("text").to_pylist(), batch.column("wanted").to_pylist(), strict=True):
            lines = (text or "").lower().split("\n")
            for w in wanted:
                body = normal_line(lines[w["line"]])
                rows.append((w["node"], w["root"], w["sim"], body, len(body)))
        if rows:
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64())
            columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, ["node", "root", "sim", "body", "weight"])


_WORDS = {c: " " for c in range(0x80) if _BETWEEN[c]} | {c: "0" for c in range(0x30, 0x3A)}


def normal_line(line: str) -> str:
    return " ".join(w for w in line.lower().translate(_WORDS).split(" ") if w)


def dedup_lines(
    docs: DataFrame,
    rule: LineRule = LineRule(),
    block_weight: int = BLOCK_WEIGHT,
    counts: bool = True,
    drop_emptied: bool = False,
) -> DataFrame:
    """The documents without the repeated lines, and how many lines went.

    Lines are what ``\\n`` separates. Those with fewer than ``least_words`` words
    in normal form (case, digits and signs alike) always stay; of each group of
    linked others one occurrence stays, the first by (doc_id, line), a null
    doc_id last. With ``counts`` adds n_lines and n_removed (long), in place of
    columns of these names; others are carried along. With ``drop_emptied``
    documents go that lost a line and have no word left in the others.

    A null text stays null, an empty one empty. Rows alike in doc_id and text
    are one document to this operator: what is kept in one is kept in all.
    """
    added = ("n_lines", "n_removed") if counts else ()
    given = docs.select(*[c for c in docs.columns if c not in added])
    keyed = given.withColumn("__doc", row_key())
    unique = keyed.select(F.col("doc_id").cast("long"), F.col("__doc").alias("doc"), "text").where("text IS NOT NULL")
    lines = line_groups(unique, rule, block_weight)
    lists = (
        lines.groupBy("doc")
        .agg(F.collect_set(F.when(~F.col("kept"), F.col("line"))).alias("__gone"))
        .where(F.size("__gone") > 0)
    )
    joined = keyed.join(lists.withColumnRenamed("doc", "__doc"), "__doc", "left").drop("__doc")
    lines = F.split("text", "\n", -1)
    rest = F.array_join(F.filter("__lines", lambda _, i: ~F.array_contains("__gone", i)), "\n")
    out = joined.withColumn("__lines", lines).withColumn(
        "text", F.when(F.col("__gone").isNull(), F.col("text")).otherwise(rest)
    )
    if drop_emptied:
        # A word is what find_lines() takes for one: anything but ASCII signs and white space.
        out = out.where(F.col("__gone").isNull() | F.col("text").rlike(r"[0-9A-Za-z]|[^\x00-\x7F]"))
    if counts:
        out = out.withColumn("n_lines", F.coalesce(F.size("__lines"), F.lit(0)).cast("long"))
        out = out.withColumn("n_removed", F.coalesce(F.size("__gone"), F.lit(0)).cast("long"))
    return out.drop("__gone", "__lines")
