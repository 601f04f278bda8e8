"""Exact substring deduplication by common-prefix intervals of enhanced suffix arrays."""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starloom.llm.common import column_bytes, mix, prefix_sums, row_key, span_hash, text_slices, written
from starloom.llm.linking import runs
from starloom.session import source_bytes

LENGTH = 50
GRAM = 20
# Anchors that meet in one task: so many bytes of source files.
BYTES_PER_BUCKET = 6 << 20
# Bytes of text in one suffix array.
ARRAY_BYTES = 1 << 20


class Interval(NamedTuple):
    """A maximal repeat: its length and its suffixes, a range of the suffix array."""

    length: int
    low: int
    high: int


class SuffixArray:
    """The suffixes of some chunks that are ``least`` bytes or longer, in order, with common prefixes.

    Suffixes end with their chunk. Order and common prefixes are exact up to
    ``most`` bytes, the length of the longest chunk.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, least: int):
        self.least = least
        sizes = np.diff(offsets)
        most = int(sizes.max()) if len(sizes) else 0
        # A zero ends each chunk; bytes are one higher.
        n = len(data) + len(sizes)
        text = np.zeros(n + most + 8, np.int64)
        self.chunk = np.repeat(np.arange(len(sizes)), sizes + 1)
        begin = offsets[:-1] + np.arange(len(sizes))
        place = np.arange(len(data)) + np.repeat(np.arange(len(sizes)), sizes)
        text[place] = data.astype(np.int64) + 1
        self.left = np.concatenate(([0], text[: n - 1]))
        # Ranks by the first 7 bytes, then by twice as many each round.
        rank = np.zeros(len(text), np.int64)
        for k in range(7):
            rank[: n + most] = rank[: n + most] * 257 + text[k : n + most + k]
        width = 7
        rank = np.unique(rank, return_inverse=True)[1]
        ranks = [(7, rank)]
        self.offset = np.arange(n) - begin[self.chunk] if n else np.zeros(0, np.int64)
        rest = sizes[self.chunk] - self.offset
        own = np.flatnonzero(rest >= least)
        goal = max(least, most)
        while width < goal:
            shifted = np.zeros_like(rank)
            shifted[: len(rank) - width] = rank[width:]
            pairs = rank * (len(rank) + 1) + shifted
            if 2 * width < goal:
                rank = np.unique(pairs, return_inverse=True)[1]
            else:  # the widest ranks are asked for own suffixes alone
                rank = np.zeros_like(rank)
                rank[own] = np.unique(pairs[own], return_inverse=True)[1]
            width *= 2
            ranks.append((width, rank))
        self.order = own[np.argsort(rank[own], kind="stable")]
        # Common prefix of neighbours, from the widest ranks down, within both chunks.
        a, b = self.order[:-1].copy(), self.order[1:].copy()
        common = np.zeros(len(a), np.int64)
        for width, rank in reversed(ranks):
            same = rank[np.minimum(a, len(rank) - 1)] == rank[np.minimum(b, len(rank) - 1)]
            common[same] += width
            a[same] += width
            b[same] += width
        going = np.ones(len(a), bool)
        for _ in range(6):  # less than one rank of 7 bytes is left
            going &= text[np.minimum(a, len(text) - 1)] == text[np.minimum(b, len(text) - 1)]
            for x in (common, a, b):
                x[going] += 1
        limit = np.minimum(rest[self.order[:-1]], rest[self.order[1:]]) if len(self.order) else np.zeros(0, np.int64)
        self.common = np.minimum(common, limit)

    def maximal_repeats(self) -> Iterator[Interval]:
        """Walk the tree of common-prefix intervals; give those that no left byte extends.

        One scan with a stack. An interval is extended to the left if the same
        byte stands before all its suffixes; the start of a chunk is no byte.
        """
        common, least = self.common, self.least
        left = self.left[self.order]
        diverse = np.concatenate(([0], np.cumsum((left[1:] != left[:-1]) | (left[1:] == 0))))
        near = np.flatnonzero(common >= least)
        if not len(near):
            return
        heights = common.tolist()
        breaks = np.flatnonzero(np.diff(near) > 1)
        for low, high in zip(near[np.concatenate(([0], breaks + 1))].tolist(), near[np.append(breaks, len(near) - 1)].tolist(), strict=True):
            if diverse[high + 1] == diverse[low]:
                # Before every suffix of the whole run stands one byte: so it does within each interval.
                continue
            stack: list[tuple[int, int]] = []
            for i in range(low, high + 2):
                height = heights[i] if i <= high else 0
                start = i
                while stack and stack[-1][0] > height:
                    top, start = stack.pop()
                    if diverse[i] != diverse[start]:
                        yield Interval(top, start, i + 1)
                if height >= least and (not stack or stack[-1][0] < height):
                    stack.append((height, start))


def repeat_marks(column: pa.Array, docs: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(chunk, start, end) of what repeats a chunk of a smaller document."""
    data, offsets = _binary(column)
    array = SuffixArray(data, offsets, least)
    chunks, starts, ends = [], [], []
    chunk, offset = array.chunk[array.order] if len(array.order) else array.order, array.offset[array.order]
    owner = docs[chunk] if len(chunk) else chunk
    for length, low, high in array.maximal_repeats():
        own = owner[low:high]
        later = np.flatnonzero(own > own.min()) + low
        chunks.append(chunk[later])
        starts.append(offset[later])
        ends.append(offset[later] + length)
    if not chunks:
        none = np.zeros(0, np.int64)
        return none, none, none
    return np.concatenate(chunks), np.concatenate(starts), np.concatenate(ends)


def _binary(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    parts = column.to_pylist()
    offsets = np.concatenate(([0], np.cumsum([len(p) for p in parts]))).astype(np.int64)
    return np.frombuffer(b"".join(parts), np.uint8), offsets


# --- anchors -------------------------------------------------------------------


def find_anchors(data: np.ndarray, offsets: np.ndarray, length: int, gram: int):
    """Text, position, hash and neighbourhood of the anchors of some texts.

    Every string of ``length`` bytes has one anchor: of its ``gram``-byte parts
    the first with the smallest hash. So equal strings have equal anchors, at
    the same place. The neighbourhood is all that strings of this anchor cover.
    """
    none = np.zeros(0, np.int64)
    n = len(data) - length + 1
    if n <= 0:
        return none, none, none.view(np.uint64), none.view(np.uint64)
    sums = prefix_sums(data)
    starts = np.arange(len(data) - gram + 1)
    value = span_hash(sums, starts, starts + gram)
    span, width = length - gram + 1, 1
    low, at = value, starts.astype(np.int32)
    while width < span:
        step = min(width, span - width)
        take = low[step:] < low[:-step]
        at = np.where(take, at[step:], at[:-step])
        low = np.minimum(low[step:], low[:-step])
        width += step
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    whole = text[: len(at)] == text[length - 1 : length - 1 + len(at)]
    at = at[whole]
    if not len(at):
        return none, none, none.view(np.uint64), none.view(np.uint64)
    at = at[np.concatenate(([True], at[1:] != at[:-1]))].astype(np.int64)
    owner = text[at]
    begin = np.maximum(at - (length - gram), offsets[owner])
    end = np.minimum(at + length, offsets[owner + 1])
    around = span_hash(sums, begin, end) + ((at - begin) * 256 + (end - at)).astype(np.uint64)
    return owner, at - offsets[owner], value[at], around


_ROW = np.dtype([("h", "<u8"), ("around", "<u8"), ("doc_id", "<i8"), ("doc", "<i8"), ("start", "<i4"), ("at", "<i4"), ("end", "<i4")])


def _later_copies(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows by anchor and neighbourhood, and which of them repeat a smaller document's."""
    rows = rows[np.lexsort((rows["doc_id"], rows["around"], rows["h"]))]
    new = np.concatenate(([True], (rows["h"][1:] != rows["h"][:-1]) | (rows["around"][1:] != rows["around"][:-1])))
    first = rows["doc_id"][np.flatnonzero(new)][np.cumsum(new) - 1]
    return rows, rows["doc_id"] > first


def _deal(n_buckets: int, length: int, gram: int):
    """Anchors of each slice, dealt by hash; copies within the slice are marked at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            data, offsets = column_bytes(batch.column("text"))
            ids, docs = batch.column("doc_id").to_numpy(), batch.column("doc").to_numpy()
            owner, at, h, around = find_anchors(data, offsets, length, gram)
            if not len(owner):
                continue
            rows = np.zeros(len(owner), _ROW)
            rows["h"], rows["around"], rows["at"] = h, around, at
            rows["doc_id"], rows["doc"] = ids[owner], docs[owner]
            rows["start"] = np.maximum(at - (length - gram), 0)
            rows["end"] = np.minimum(at + length, np.diff(offsets)[owner])
            rows, later = _later_copies(rows)
            marks, rows = rows[later], rows[~later]
            bucket = (rows["h"] % np.uint64(n_buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            rows, bucket = rows[order], bucket[order]
            cuts = [0, *(np.flatnonzero(bucket[1:] != bucket[:-1]) + 1), len(bucket)]
            sent = [(int(bucket[a]), _pack(rows[a:b]), b"") for a, b in zip(cuts, cuts[1:], strict=False) if b > a]
            if len(marks):
                # Marks meet nothing, so any bucket will do: by document, as one passage may stand in every slice.
                united = _united(marks[["doc", "start", "end"]].astype(_MARK))
                sent.append((int(mix(united["doc"][:1].view(np.uint64))[0] % np.uint64(n_buckets)), b"", united.tobytes()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(zip(*sent, strict=True), (pa.int32(), pa.binary(), pa.binary()), strict=True)],
                ["bucket", "anchors", "marks"],
            )

    return run


_MARK = np.dtype([("doc", "<i8"), ("start", "<i4"), ("end", "<i4")])


def _united(marks: np.ndarray) -> np.ndarray:
    """Marks of a document that touch or overlap, as one."""
    marks = marks[np.lexsort((marks["start"], marks["doc"]))]
    new = np.concatenate(([True], marks["doc"][1:] != marks["doc"][:-1]))
    # Documents lie apart by more than any text is long.
    apart = (np.cumsum(new) - 1) << 32
    start, end = marks["start"] + apart, np.maximum.accumulate(marks["end"] + apart)
    begin = np.flatnonzero(np.concatenate(([True], start[1:] > end[:-1])))
    out = marks[begin]
    out["end"] = np.append(end[begin[1:] - 1], end[-1:]) - apart[begin]
    return out


def _pack(rows: np.ndarray) -> bytes:
    """Rows without what repeats: the documents apart, positions as one number each."""
    docs, owner = np.unique(rows[["doc_id", "doc"]], return_inverse=True)
    head = np.array([len(rows), len(docs)], "<i8").tobytes()
    span = (rows["at"] - rows["start"]).astype("u1"), (rows["end"] - rows["at"]).astype("u1")
    columns = (rows["h"].tobytes(), rows["around"].tobytes(), owner.astype("<u4").tobytes(), rows["at"].tobytes())
    return b"".join((head, docs["doc_id"].tobytes(), docs["doc"].tobytes(), *columns, span[0].tobytes(), span[1].tobytes()))


def _unpack(blob: bytes) -> np.ndarray:
    n, m = np.frombuffer(blob, "<i8", 2)
    place = 16
    out = []
    for kind, count in (("<i8", m), ("<i8", m), ("<u8", n), ("<u8", n), ("<u4", n), ("<i4", n), ("u1", n), ("u1", n)):
        out.append(np.frombuffer(blob, kind, count, place))
        place += out[-1].nbytes
    rows = np.zeros(n, _ROW)
    rows["h"], rows["around"], rows["at"] = out[2], out[3], out[5]
    rows["doc_id"], rows["doc"] = out[0][out[4]], out[1][out[4]]
    rows["start"], rows["end"] = out[5] - out[6], out[5] + out[7]
    return rows


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Settle anchors whose neighbourhoods are all alike; pass on those with several."""
    for group in runs(batches, "bucket"):
        done = [np.frombuffer(m, _MARK) for m in group["marks"].to_pylist() if m]
        blobs = [_unpack(b) for b in group["anchors"].to_pylist() if b]
        open_rows = np.zeros(0, _ROW)
        if blobs:
            rows, later = _later_copies(np.concatenate(blobs))
            if later.any():
                done.append(_united(rows[later][["doc", "start", "end"]].astype(_MARK)))
            rows = rows[~later]
            new = np.concatenate(([True], rows["h"][1:] != rows["h"][:-1]))
            begin, which = np.flatnonzero(new), np.cumsum(new) - 1
            several = np.minimum.reduceat(rows["doc_id"], begin) < np.maximum.reduceat(rows["doc_id"], begin)
            open_rows = rows[several[which]]
        for marks in done:
            for a in range(0, len(marks), 50_000):
                part = marks[a : a + 50_000]
                none = pa.nulls(len(part), pa.int64())
                yield _rows(part["doc"], part["start"], part["end"], none, none)
        for a in range(0, len(open_rows), 50_000):
            part = open_rows[a : a + 50_000]
            yield _rows(part["doc"], part["start"], part["end"], pa.array(part["h"].view("<i8")), pa.array(part["doc_id"].copy()))


def _rows(doc, start, end, h, doc_id) -> pa.RecordBatch:
    first = [pa.array(np.ascontiguousarray(x)) for x in (doc, start, end)]
    return pa.RecordBatch.from_arrays([*first, h, doc_id], ["doc", "start", "end", "h", "doc_id"])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The neighbourhoods of the open anchors of each document, as bytes."""
    for batch in text_slices(batches):
        for text, doc, spots in zip(*(batch.column(c).to_pylist() for c in ("text", "doc", "spots")), strict=True):
            data = text.encode()
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([s["h"] for s in spots], pa.int64()),
                    pa.array([s["doc_id"] for s in spots], pa.int64()),
                    pa.array([doc] * len(spots), pa.int64()),
                    pa.array([s["start"] for s in spots], pa.int32()),
                    pa.array([data[s["start"] : s["end"]] for s in spots], pa.binary()),
                ],
                ["h", "doc_id", "doc", "start", "chunk"],
            )


def _search(least: int):
    """Suffix arrays over the neighbourhoods of some anchors, and the repeats found in them."""

    def search(tables: list[pa.Table]) -> pa.RecordBatch:
        table = pa.concat_tables(tables).combine_chunks()
        docs = table["doc_id"].to_numpy()
        chunk, start, end = repeat_marks(table["chunk"].chunk(0), docs, least)
        base = table["start"].to_numpy()[chunk]
        marks = np.zeros(len(chunk), _MARK)
        marks["doc"], marks["start"], marks["end"] = table["doc"].to_numpy()[chunk], base + start, base + end
        # Intervals within intervals mark the same bytes.
        marks = _united(marks) if len(marks) else marks
        names = ["doc", "start", "end"]
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(marks[c])) for c in names], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for group in runs(batches, "h"):
            if group.num_rows > 1:
                held.append(group)
                size += group.nbytes
            if size > ARRAY_BYTES:
                yield search(held)
                held, size = [], 0
        if held:
            yield search(held)

    return run


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(doc, start, end): bytes of a document that a string of ``length`` bytes or
    more covers which also stands in a document of smaller id; docs: doc_id, doc, text.

    Spans overlap and repeat; their union is exact. Every string has one anchor,
    so documents are never compared: anchors meet by their hash. Where all
    neighbourhoods of an anchor are alike, nothing is left to find; the others
    go into suffix arrays, whose maximal repeats are the spans.
    """
    n_buckets = max(
        int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(source_bytes(docs) / BYTES_PER_BUCKET)
    )
    known = docs.where("doc_id IS NOT NULL AND text IS NOT NULL")
    dealt = known.mapInArrow(_deal(n_buckets, length, gram), "bucket int, anchors binary, marks binary")
    # One bucket a partition; by their hash six of 86 would meet in one.
    met = written(
        dealt.repartitionById(n_buckets, "bucket")
        .sortWithinPartitions("bucket")
        .mapInArrow(_meet, "doc long, start int, end int, h long, doc_id long")
    )
    spots = met.where("h IS NOT NULL").groupBy("doc").agg(F.collect_list(F.struct("h", "doc_id", "start", "end")).alias("spots"))
    chunks = known.select("doc", "text").join(spots, "doc").mapInArrow(_cut, "h long, doc_id long, doc long, start int, chunk binary")
    found = chunks.repartition("h").sortWithinPartitions("h").mapInArrow(_search(length), "doc long, start int, end int")
    return met.where("h IS NULL").select("doc", "start", "end").unionAll(found)


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in text_slices(batches):
        rest, removed, spans = [], [], []
        for text, marks in zip(batch.column("text").to_pylist(), batch.column("marks").to_pylist(), strict=True):
            data = (text or "").encode()
            at, kept, n = 0, [], 0
            merged: list[list[int]] = []
            for mark in sorted(marks or ()):
                start, end = mark >> 32, mark & 0xFFFFFFFF
                if merged and start <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], end)
                else:
                    merged.append([start, end])
            for start, end in merged:
                kept.append(data[at:start])
                n += end - start
                at = end
            kept.append(data[at:])
            rest.append(b"".join(kept))
            removed.append(n)
            spans.append([{"start": a, "end": b} for a, b in merged])
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                pa.array([len(r) + n for r, n in zip(rest, removed, strict=True)], pa.int64()),
                pa.array(removed, pa.int64()),
                pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                pa.array(rest, pa.binary()),
            ],
            ["doc_id", "n_bytes", "n_removed", "spans", "rest"],
        )


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(doc_id, n_bytes, n_removed, spans, rest): each document without what smaller ones hold.

    Texts are UTF-8 bytes, a null one is empty. A byte goes if a string of
    ``length`` bytes over it also starts in a document with a smaller doc_id.
    spans are the removed runs, in order; rest the other bytes, which need not
    be valid UTF-8. Rows with a null id neither lose bytes nor cost others any;
    rows of one id leave each other alone. Repeated rows come back each. Other
    columns are not read.
    """
    if length - gram > 200 or gram > length:
        raise ValueError("a gram is at most as long as the string, and at most 200 bytes shorter")
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key().alias("doc"), "text")
    mark = F.shiftleft(F.col("start").cast("long"), 32) + F.col("end")
    marks = written(repeated_spans(given, length, gram)).groupBy("doc").agg(F.collect_set(mark).alias("marks"))
    return given.join(marks, "doc", "left").select("doc_id", "text", "marks").mapInArrow(
        _remove, "doc_id long, n_bytes long, n_removed long, spans array<struct<start: long, end: long>>, rest binary"
    )
