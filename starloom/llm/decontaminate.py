"""Benchmark decontamination: runs of bytes that outlast the edits, CGK embedding, bit-sampling LSH, exact edit check."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from starloom.llm.common import text_slices, word_spans
from starloom.llm.editing import best_substring
from starloom.llm.line_dedup import _BETWEEN as BETWEEN
from starloom.llm.line_dedup import _normal as normal_bytes
from starloom.llm.line_dedup import normal_line

# Items with fewer words prove nothing.
LEAST_WORDS = 3
# A seed is at most so many bytes, and shorter if fewer than so many of an edited item's would be left.
SEED_BYTES = 8
LEAST_SHARED = 6
# Items as long as this or longer lose the same share of their seeds.
LONG_ITEM = 1_000
# Characters of benchmark items that travel to the tasks at once.
BLOCK_CHARS = 4_000_000
# Cells of the table that counts seeds; windows embedded at once.
CELLS = 1 << 17
WINDOWS_AT_ONCE = 4096
# Edited copies of items by which the size of a key is chosen.
COPIES = 400
_LEAK = StructType([StructField("item_id", LongType()), StructField("start", LongType()), StructField("end", LongType()), StructField("similarity", DoubleType())])


class LeakRule(NamedTuple):
    """Windows leak an item at ``similarity`` (1 - edits / characters) or more.

    Windows are laid where as many seeds of an item stand as are left of it at
    the least similarity, edits falling anywhere, for ``recall``. Of each of
    ``walks`` embeddings ``sampled`` places are drawn. A key is a choice of these
    places; all keys of one size are tried at once, as a window has one in common
    with its item if it agrees in so many places. The size is the largest at
    which edited copies of the items, at the least similarity, are found with ``recall``.
    """

    similarity: float = 0.8
    recall: float = 0.98
    sampled: int = 96
    walks: int = 12


def cgk_embed(strings: list[bytes], walk: np.ndarray) -> np.ndarray:
    """The random-walk embedding of each string: one row of bytes as long as the walk.

    At step t the byte under the head is written; the head moves on if the walk
    says so for that byte. Equal walks keep strings of few edits close in
    Hamming distance. A string takes as many steps as it has bytes, so its head never
    passes its end; what lies beyond is 0 and says nothing.
    """
    lengths = np.array([min(len(s), len(walk)) for s in strings], np.int64)
    order = np.argsort(-lengths, kind="stable")
    head = np.concatenate(([0], np.cumsum(lengths[order])))[:-1]
    flat = np.frombuffer(b"".join(strings[i][: lengths[i]] for i in order), np.uint8)
    # The longest first, so those that still walk are the first rows.
    left = len(strings) - np.searchsorted(lengths[order][::-1], np.arange(len(walk)), side="right")
    steps, table = np.zeros((len(walk), len(strings)), np.uint8), walk.astype(np.int64)
    for t, n in enumerate(left.tolist()):
        if not n:
            break
        steps[t, :n] = flat[head[:n]]
        head = head[:n] + table[t][steps[t, :n]]
    out = np.empty((len(strings), len(walk)), np.uint8)
    out[order] = steps.T
    return out


def _walks(steps: int, n: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(97)).integers(0, 2, (n, steps, 256), dtype=np.int8)


@lru_cache(maxsize=None)
def _seeds_left(size: int, edits: int, width: int, seed: int, miss: float) -> int:
    """Seeds that all but ``miss`` of the copies of an item keep whose edits, ``width`` bytes each, fall anywhere."""
    if size > LONG_ITEM:
        return _seeds_left(LONG_ITEM, -(-edits * LONG_ITEM // size), width, seed, miss) * size // LONG_ITEM
    draws = np.random.default_rng(size).random((1_000, size))
    hit = np.zeros((len(draws), size + width), np.int64)
    if edits:
        places = np.argpartition(draws, edits, axis=1)[:, :edits]
        for k in range(width):
            hit[np.arange(len(draws))[:, None], places + k] = 1
    before = np.cumsum(np.pad(hit[:, :size], ((0, 0), (1, 0))), axis=1)
    left = (before[:, seed:] == before[:, : size + 1 - seed]).sum(axis=1)
    return int(np.quantile(left, miss, method="lower"))


def _packed(body: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, the first one lowest."""
    out, have = body.astype(np.uint64), 1
    while have < 8:
        out[:-have] |= out[have:] << np.uint64(8 * have)
        have *= 2
    return out


class Seeds(NamedTuple):
    """Runs of ``size`` bytes by their hash, where each one's items begin in the lists, and the items and places in them.

    ``maybe`` tells by a hash which runs can be known, ``first`` where the known runs of a coarser hash begin.
    """

    size: int
    known: np.ndarray
    bounds: np.ndarray
    item: np.ndarray
    place: np.ndarray
    maybe: np.ndarray
    first: np.ndarray

    def cut(self, packed: np.ndarray) -> np.ndarray:
        return packed & np.uint64((1 << 8 * self.size) - 1)

    @staticmethod
    def spread(seeds: np.ndarray) -> np.ndarray:
        return ((seeds * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)).astype(np.int64)

    def find(self, runs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the runs are known, and where in ``known``."""
        cell = self.spread(runs) >> 2
        at, end = self.first[cell], self.first[cell + 1]
        out = np.full(len(runs), -1, np.int64)
        todo = np.flatnonzero(at < end)
        while len(todo):
            same = self.known[at[todo]] == runs[todo]
            out[todo[same]] = at[todo[same]]
            todo = todo[~same]
            at[todo] += 1
            todo = todo[at[todo] < end[todo]]
        found = np.flatnonzero(out >= 0)
        return found, out[found]


class Region(NamedTuple):
    """A part of the texts that may hold an item, and where windows of its size begin there."""

    item: int
    low: int
    high: int
    windows: set[int]


class BenchmarkIndex:
    """Items of one block: their seeds, embeddings' keys and texts."""

    def __init__(self, items: list[tuple[int, str]], rule: LeakRule):
        self.rule = rule
        given = [(i, normal_line(t or "")) for i, t in items]
        self.items = [(i, t) for i, t in given if t.count(" ") >= LEAST_WORDS - 1]
        self.encoded = [t.encode() for _, t in self.items]
        self.sizes = np.array([len(e) for e in self.encoded], np.int64)
        # A little more than the rule allows, as similarities are rounded; bytes an edit may touch.
        allowed = [int((1 - rule.similarity) * len(t) + 1e-6) for _, t in self.items]
        widths = [-(-len(e) // len(t)) for e, (_, t) in zip(self.encoded, self.items, strict=True)]
        self.reach = np.array([e * w for e, w in zip(allowed, widths, strict=True)], np.int64)
        self.least = np.ones(len(self.items), np.int64)
        chosen = np.zeros(len(self.items), np.int64)
        for n, (size, edits, width) in enumerate(zip(self.sizes.tolist(), allowed, widths, strict=True)):
            for chosen[n] in range(min(SEED_BYTES, size), 0, -1):
                self.least[n] = max(1, _seeds_left(size, edits, width, int(chosen[n]), (1 - rule.recall) / 4))
                if self.least[n] >= LEAST_SHARED:
                    break
        self.seeds = [self._listed(n, np.flatnonzero(chosen == n).tolist()) for n in sorted(set(chosen.tolist()))]
        if self.items:
            self._embed()

    def _listed(self, size: int, own: list[int]) -> Seeds:
        empty = Seeds(size, *[np.zeros(0, np.int64)] * 6)
        found = [empty.cut(_packed(np.frombuffer(self.encoded[n], np.uint8)))[: len(self.encoded[n]) - size + 1] for n in own]
        item = np.repeat(own, [len(x) for x in found])
        place = np.concatenate([np.arange(len(x)) for x in found])
        seeds = np.concatenate(found)
        order = np.lexsort((seeds, Seeds.spread(seeds)))
        seeds = seeds[order]
        begins = np.flatnonzero(np.concatenate(([True], seeds[1:] != seeds[:-1]))) if len(seeds) else np.zeros(0, np.int64)
        known = seeds[begins]
        maybe = np.zeros(1 << 20, bool)
        maybe[Seeds.spread(known)] = True
        first = np.searchsorted(Seeds.spread(known) >> 2, np.arange((1 << 18) + 1)).astype(np.int32)
        return Seeds(size, known, np.append(begins, len(seeds)), item[order], place[order], maybe, first)

    def _embed(self) -> None:
        rule, draw = self.rule, np.random.default_rng(5)
        self.walks = _walks(int(self.sizes.max()), rule.walks)
        embedded = [cgk_embed(self.encoded, w) for w in self.walks]
        # The places of each item that are compared, and its bytes there.
        self.places = (draw.random((rule.walks, 1, rule.sampled)) * self.sizes[None, :, None]).astype(np.int64)
        self.bits = np.stack([np.take_along_axis(e, p, axis=1) for e, p in zip(embedded, self.places, strict=True)])
        # Copies edited as much as the rule allows, in the windows that their own seeds lay.
        some = np.linspace(0, len(self.encoded) - 1, min(len(self.encoded), 100)).astype(int).tolist()
        agree = []
        for i in some * -(-COPIES // max(1, len(some))):
            size = int(self.sizes[i])
            edited = _replaced(self.encoded[i], int((1 - rule.similarity) * len(self.items[i][1])), draw)
            body = np.frombuffer(b" " * size + edited + b" " * size, np.uint8)
            laid = [max(0, w) for region in self.regions(body) if region.item == i for w in region.windows]
            if laid:
                agree.append(int(self.agreement(np.full(len(laid), i), [body[w : w + size].tobytes() for w in laid]).max()))
        self.joined = max(1, int(np.quantile(agree, (1 - rule.recall) / 2, method="lower"))) if agree else 1

    def agreement(self, which: np.ndarray, windows: list[bytes]) -> np.ndarray:
        """Sampled places in which windows agree with their item, in the walk where they do most."""
        most = np.zeros(len(windows), np.int64)
        for walk, places, bits in zip(self.walks, self.places, self.bits, strict=True):
            same = np.take_along_axis(cgk_embed(windows, walk), places[which], axis=1) == bits[which]
            most = np.maximum(most, same.sum(axis=1))
        return most

    def collides(self, which: np.ndarray, windows: list[bytes]) -> np.ndarray:
        """Which windows have a key in common with their item, in any walk."""
        out = np.zeros(len(windows), bool)
        for a in range(0, len(windows), WINDOWS_AT_ONCE):
            b = a + WINDOWS_AT_ONCE
            out[a:b] = self.agreement(which[a:b], windows[a:b]) >= self.joined
        return out

    def regions(self, body: np.ndarray) -> list[Region]:
        """Where enough seeds of an item stand as far apart as its edits allow."""
        packed, out = _packed(body), []
        for seeds in self.seeds:
            runs = seeds.cut(packed)
            spots = np.flatnonzero(seeds.maybe[Seeds.spread(runs)])
            found, at = seeds.find(runs[spots])
            spots = spots[found]
            many = seeds.bounds[at + 1] - seeds.bounds[at]
            entry = np.repeat(seeds.bounds[at] - np.cumsum(many) + many, many) + np.arange(many.sum())
            out.extend(self._dense(np.repeat(spots, many), seeds.item[entry], seeds.place[entry], len(body)))
        return out

    def _dense(self, spots: np.ndarray, item: np.ndarray, place: np.ndarray, n: int) -> Iterator[Region]:
        # Seeds of one passage begin their item at places no further apart than its edits reach: in two bands in a row.
        begin = spots - place + self.sizes[item]
        step = self.reach + 1
        band = begin // step[item] + 1
        # First by a table that may add the counts of other bands.
        cell = ((item * 0x9E3779B1 + band) & (CELLS - 1)) + 1
        counts = np.bincount(cell, minlength=CELLS + 2)
        counts[0], counts[-1] = counts[-2], counts[1]
        some = counts[cell] + np.maximum(counts[cell - 1], counts[cell + 1]) >= self.least[item]
        begin, item, place, band = begin[some], item[some], place[some], band[some]
        room = ((n + self.sizes) // step + 3) * self.sizes
        base = np.concatenate(([0], np.cumsum(room)))
        keys = base[item] + band * self.sizes[item] + place
        both = np.concatenate((keys, keys - self.sizes[item]))
        both, first = np.unique(both, return_index=True)
        if not len(both):
            return
        item, begin = np.tile(item, 2)[first], np.tile(begin, 2)[first]
        band = (both - base[item]) // self.sizes[item]
        cuts = np.flatnonzero(np.concatenate(([True], (item[1:] != item[:-1]) | (band[1:] != band[:-1]))))
        ends = np.append(cuts[1:], len(both))
        own = ends - cuts >= self.least[item[cuts]]
        last, upto = None, 0
        for a, b in zip(cuts[own].tolist(), ends[own].tolist(), strict=True):
            i, at = int(item[a]), int(band[a]) - 1
            size, reach = int(self.sizes[i]), int(self.reach[i])
            low, high = at * (reach + 1) - size - reach, (at + 2) * (reach + 1) + reach
            # The first seed knows best where the passage begins, unless it is there by chance.
            laid = {int(begin[a]) - size, sorted(begin[a:b].tolist())[(b - a) // 2] - size}
            if last and last.item == i and at == upto + 1:
                last, upto = last._replace(high=high, windows=last.windows | laid), at
                continue
            if last:
                yield last
            last, upto = Region(i, low, high, laid), at
        if last:
            yield last


def _joined(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words with a blank before each, and where they begin."""
    lengths = ends - starts
    begins = np.cumsum(lengths + 1) - lengths
    body = np.full(int((lengths + 1).sum()), 0x20, np.uint8)
    word = np.ones(len(body), bool)
    word[begins - 1] = False
    body[word] = data[~BETWEEN[data]]
    return body, begins


def _replaced(text: bytes, edits: int, draw: np.random.Generator) -> bytes:
    """The text with so many bytes replaced: no other edits change the embedding more."""
    out = np.frombuffer(text, np.uint8).copy()
    at = draw.permutation(len(out))[:edits]
    out[at] = 0x61 + (out[at] + draw.integers(1, 26, len(at))) % 26
    return out.tobytes()


def _find(index: BenchmarkIndex, column: pa.Array) -> dict[int, list[dict]]:
    """Leaks of each text that has some."""
    rule = index.rule
    data, offsets = normal_bytes(column)
    starts, ends, first = word_spans(data, offsets, BETWEEN)
    if len(starts) < LEAST_WORDS - 1:
        return {}
    body, begins = _joined(data, starts, ends)
    # A text goes from its first word to the blank before the next one's; seeds over its end only add windows.
    opens = np.append(begins, len(body) + 1)[first]
    which, windows, spans = [], [], []
    for region in index.regions(body):
        t = max(0, int(np.searchsorted(opens, region.low, side="right")) - 1)
        while t < len(opens) - 1 and opens[t] < region.high:
            low, high = max(region.low, int(opens[t])), min(region.high, int(opens[t + 1]) - 1)
            for at in sorted(region.windows) if low < high else ():
                a, b = max(at, int(opens[t])), min(at + int(index.sizes[region.item]), int(opens[t + 1]) - 1)
                if a < b:
                    which.append(region.item)
                    windows.append(body[a:b].tobytes())
                    spans.append((t, low, high))
            t += 1
    if not which:
        return {}
    hits = np.flatnonzero(index.collides(np.array(which), windows)).tolist()
    best: dict[tuple[int, int], dict] = {}
    for (t, low, high), item in sorted({(spans[n], which[n]) for n in hits}):
        pattern = index.items[item][1]
        text = body[low:high].tobytes().decode("utf-8", "replace")
        edits, end = best_substring(pattern, text)
        similarity = 1 - edits / len(pattern)
        if similarity >= rule.similarity and similarity > best.get((t, item), {"similarity": 0})["similarity"]:
            length = best_substring(pattern[::-1], text[:end][::-1])[1]
            bounds = (low + len(text[: end - length].encode()), low + len(text[:end].rstrip(" ").encode()))
            start, stop = np.searchsorted(begins, bounds, side="right") - (1, 0)
            best[(t, item)] = {"item_id": index.items[item][0], "start": max(0, int(start - first[t])), "end": int(stop - first[t]), "similarity": similarity}
    out: dict[int, list[dict]] = {}
    for (t, _), leak in sorted(best.items()):
        out.setdefault(t, []).append(leak)
    return out


def find_leaks(
    docs: DataFrame, benchmark: DataFrame, rule: LeakRule = LeakRule(), out: str = "leaks"
) -> DataFrame:
    """Add ``leaks`` (or ``out``) to each document: the benchmark items it holds, and where.

    Texts are compared as words without case, signs and white space, digits
    alike. Item-sized windows are laid where as many short runs of an item's
    bytes stand as edits at the least similarity leave of it; a window whose
    embedding has a key in common with the item is verified by the exact edit
    similarity of the text around. start and end count words.
    leaks is an empty array for clean documents and null or empty texts. An item
    with fewer than three words, a null text or a null id proves nothing and is
    never found. Repeated rows and items are each judged. Documents are scanned
    once for each block of items; a column of that name is replaced.
    """
    found = docs.select(*[c for c in docs.columns if c != out]).withColumn(out, F.array().cast(ArrayType(_LEAK)))
    given = benchmark.where("item_id IS NOT NULL AND text IS NOT NULL").select(F.col("item_id").cast("long"), "text")
    chars = given.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(2 * chars / BLOCK_CHARS))
    for block in range(blocks if chars else 0):
        own = given.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).orderBy("item_id", "text")
        index = docs.sparkSession.sparkContext.broadcast(BenchmarkIndex([tuple(r) for r in own.collect()], rule))
        found = _scan(found, index, out)
    return found


def _scan(docs: DataFrame, index, out: str) -> DataFrame:
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            leaks = batch.column(out).to_pylist()
            if index.value.items:
                for t, more in _find(index.value, batch.column("text")).items():
                    leaks[t] = leaks[t] + more
            at = batch.schema.get_field_index(out)
            yield batch.set_column(at, batch.schema.field(at), pa.array(leaks, batch.schema.field(at).type))

    return docs.mapInArrow(run, schema)


def remove_leaks(docs: DataFrame, benchmark: DataFrame, rule: LeakRule = LeakRule()) -> DataFrame:
    """The documents that hold no benchmark item."""
    return find_leaks(docs, benchmark, rule, "__leaks").where(F.size("__leaks") == 0).drop("__leaks")
