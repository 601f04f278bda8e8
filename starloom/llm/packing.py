"""Sum-of-squares packing of tokenized documents into fixed windows."""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from tokenizers import Tokenizer
from tokenizers.models import BPE

from starloom.llm.common import text_slices

WINDOW = 4096
# Bytes of words and their ids that a worker remembers, with what an entry costs besides.
KNOWN_BYTES = 192 << 20
ENTRY_BYTES = 200
# Windows that a task holds open, each of four bytes an id at most: 256 MB if all are nearly full.
MOST_OPEN = 16_384

_COLUMNS = ("start", "length", "doc_tokens", "sequence_id", "offset")


# A run of unaccented or western accented letters, and ASCII signs but the apostrophe behind it.
_PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)")
_PROBES = ("The", "thing,", "Éréau.", "einöber", "ción!!", "a", "zZ***", "straße")


def _byte_letters() -> dict[int, str]:
    """The letter that byte-level vocabularies use for each byte: itself if printable, else the next one from 256 on."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = [b for b in range(256) if b not in own]
    return {b: chr(256 + n) for n, b in enumerate(rest)}


class WordTokenizer:
    """Ids of a text, looked up word by word.

    The vocabulary's tokens never span white space, so a text's ids are those
    of its blank-separated words, one after the other. Only words not seen
    before go through the tokenizer: plain ones straight to its merges, if that
    proves equal for some probes, others through all its steps. The string of a
    special token becomes its id, as the tokenizer has it. Bytes of
    little-endian unsigned ids. What is remembered between two texts is bounded by its bytes.
    """

    def __init__(self, path: str, end_id: int):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[bytes, bytes] = {}
        self.held = 0
        self.tails: dict[str, bytes] = {"": b""}
        self.end = array("I", [end_id]).tobytes()
        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        self.letters = _byte_letters()
        self.merges = None
        if model.get("type") == "BPE":
            merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
            # Its own cache is too small to be worth its locks.
            self.merges = BPE(
                vocab=model["vocab"], merges=merges, end_of_word_suffix=model.get("end_of_word_suffix"), cache_capacity=0
            )
            if any(self._of_word(w.encode()) != self._in_full(w) for w in _PROBES):
                self.merges = None

    def _in_full(self, word: str) -> bytes:
        return array("I", self.tokenizer.encode(word, add_special_tokens=False).ids).tobytes()

    def _of_word(self, word: bytes) -> bytes:
        text = word.decode()
        plain = _PLAIN.fullmatch(text) if self.merges else None
        if plain is None:
            return self._in_full(text)
        letters, tail = plain[1].lower(), plain[2]
        if tail not in self.tails:
            self.held += len(tail) + ENTRY_BYTES
            self.tails[tail] = self._in_full(tail)
        if not letters.isascii():
            letters = letters.encode().decode("latin-1").translate(self.letters)
        return array("I", [t.id for t in self.merges.tokenize(letters)]).tobytes() + self.tails[tail]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        out = []
        for text in texts:
            if self.held > KNOWN_BYTES:
                self.known.clear()
                self.tails, self.held = {"": b""}, 0
            known = self.known
            words = (text or "").encode().split()
            for word in words:
                if word not in known:
                    ids = known[word] = self._of_word(word)
                    self.held += len(word) + len(ids) + ENTRY_BYTES
            out.append(b"".join([known[w] for w in words]) + self.end)
        return out


class Packer:
    """Open windows by fill level, and the choice of the level for each piece.

    ``levels[h]`` counts the open windows filled to h. A piece goes to the level
    for which the sum of the squared counts ends smallest; ties take the fullest
    window. What is still open at the end is poured together, so all windows but
    the last are full, and the last is cut into powers of two.
    """

    def __init__(self, window: int = WINDOW, first_sequence: int = 0, most_open: int | None = None):
        self.window = window
        self.most_open = most_open or MOST_OPEN
        self.levels = np.zeros(window + 1, np.int64)
        self.open: dict[int, list[list]] = {}
        self.n_open = 0
        self.sequence = first_sequence
        self.closed: list[tuple] = []

    def add(self, doc, ids: bytes) -> None:
        total = len(ids) // 4
        whole = total - total % self.window
        for start in range(0, whole, self.window):
            self._close([(doc, start, ids[4 * start : 4 * (start + self.window)], total)])
        if whole < total:
            self._place((doc, whole, ids[4 * whole :], total))

    def _place(self, piece: tuple) -> None:
        size, levels = len(piece[2]) // 4, self.levels
        # Squares change by 2 * levels[h + size] + 1 - (2 * levels[h] - 1); a full window counts for nothing.
        before = levels[: self.window - size + 1]
        gain = 2 * levels[size : self.window + 1] + 1
        gain[-1] = 0
        change = gain - np.where(before > 0, 2 * before - 1, 0)
        change[1:][before[1:] == 0] = 4 * self.most_open * self.most_open
        level = len(change) - 1 - int(np.argmin(change[::-1]))
        if level:
            window = self.open[level].pop()
            levels[level] -= 1
            self.n_open -= 1
        else:
            window = []
        window.append(piece)
        if level + size == self.window:
            self._close(window)
        else:
            self.open.setdefault(level + size, []).append(window)
            levels[level + size] += 1
            self.n_open += 1
            if self.n_open >= self.most_open:
                self.finish(whole_only=True)

    def _close(self, window: list) -> None:
        offset = 0
        for doc, start, ids, total in window:
            length = len(ids) // 4
            self.closed.append((doc, start, length, total, self.sequence, offset, ids))
            offset += length
        self.sequence += 1

    def finish(self, whole_only: bool = False) -> None:
        """Pour the open windows into full ones."""
        pieces = [p for level in sorted(self.open, reverse=True) for window in self.open[level] for p in window]
        left = sum(len(p[2]) // 4 for p in pieces)
        self.open, self.n_open = {}, 0
        self.levels[:] = 0
        current, room, last = [], 0, []
        for piece in pieces:
            while piece is not None:
                if not room:
                    if whole_only and left < self.window:
                        # No room is opened, so all pieces behind this one end here, too.
                        last.append(piece)
                        break
                    room = self.window if left >= self.window else 1 << (left.bit_length() - 1)
                doc, start, ids, total = piece
                take = min(room, len(ids) // 4)
                current.append((doc, start, ids[: 4 * take], total))
                piece = (doc, start + take, ids[4 * take :], total) if 4 * take < len(ids) else None
                room -= take
                left -= take
                if not room:
                    self._close(current)
                    current = []
        if last:
            level = sum(len(p[2]) // 4 for p in last)
            self.open[level] = [last]
            self.levels[level] = self.n_open = 1

    def take(self) -> list[tuple]:
        out, self.closed = self.closed, []
        return out


def pack_documents(
    docs: DataFrame,
    tokenizer: str,
    window: int = WINDOW,
    end_id: int = 2,
    doc_id: str = "doc_id",
    text: str = "text",
    most_open: int | None = None,
) -> DataFrame:
    """Pieces of documents and where they lie in sequences of at most ``window`` ids.

    Each task packs its own documents online and pours its open windows together
    at its end, or when ``most_open`` (16,384 by default, 256 MB of ids at most) are
    open: no id is lost by it, but the counts of levels start anew. So every sequence is full or a power of two long, and no id is
    padding. A document: the ids of its whole text by the tokenizer file (which
    every executor has at that path), then ``end_id``; a null text is an empty
    one. A null id, repeated rows and ties each make pieces of their own. No
    document: no row. Other columns are not read, so none can clash.

    Returns doc_id, start, length, doc_tokens, sequence_id, offset and ids
    (little-endian unsigned 32-bit).
    """
    given = docs.select(docs[doc_id].alias("doc_id"), docs[text].alias("text"))
    fields = ", ".join(f"{c} long" for c in _COLUMNS)
    schema = f"doc_id {given.schema['doc_id'].dataType.simpleString()}, {fields}, ids binary"

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, packer, kind = None, None, None

        def rows(done: list[tuple]) -> Iterator[pa.RecordBatch]:
            for i in range(0, len(done), 2000):
                columns = list(zip(*done[i : i + 2000], strict=True))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(columns[0], kind), *(pa.array(c, pa.int64()) for c in columns[1:6]), pa.array(columns[6], pa.binary())],
                    ["doc_id", *_COLUMNS, "ids"],
                )

        for batch in text_slices(batches):
            if words is None:
                words = WordTokenizer(tokenizer, end_id)
                packer = Packer(window, TaskContext.get().partitionId() << 33, most_open)
                kind = batch.column(0).type
            for doc, ids in zip(batch.column(0).to_pylist(), words.encode(batch.column(1).to_pylist()), strict=True):
                packer.add(doc, ids)
            yield from rows(packer.take())
        if packer is not None:
            packer.finish()
            yield from rows(packer.take())

    return given.mapInArrow(pack, schema)
