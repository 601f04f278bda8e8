"""Convolutional text classifier in numpy: hashed embeddings, several widths, max pooling."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from copy import deepcopy
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from starloom.llm.common import column_bytes, prefix_sums, starting_hashes, text_slices, word_spans, written

# Everything but ASCII letters and bytes of other scripts separates words.
_BETWEEN = np.ones(256, bool)
_BETWEEN[0x61:0x7B] = False
_BETWEEN[0x80:] = False
# Bytes of text that a step of the training, or of the scoring, handles at once.
STEP_BYTES = 1 << 20
# Bytes of labelled texts that one copy of the network learns from before the copies are mixed.
SHARD_BYTES = 1 << 23
# The word table is mixed in this many slices, the changes of so many copies at once.
SLICES = 64
FAN = 64
# Out-of-fold scores are counted by logit, in steps of 1 / LOGIT_STEPS.
LOGIT_STEPS = 256


class Shape(NamedTuple):
    """Sizes of the network. A word is its whole and its beginnings, each hashed to a row."""

    beginnings: tuple[int, ...] = (4, 6, 7, 9)
    buckets: int = 1 << 16
    dims: int = 8
    widths: tuple[int, ...] = (1, 2, 3)
    filters: int = 8


def word_rows(data: np.ndarray, offsets: np.ndarray, shape: Shape) -> tuple[np.ndarray, np.ndarray]:
    """Embedding rows of each word, and each text's first word; gaps of zeros follow a text."""
    starts, ends, first = word_spans(data, offsets, _BETWEEN)
    hashed = starting_hashes(prefix_sums(data), starts)
    gap = max(shape.widths)
    n_texts = len(offsets) - 1
    text = np.repeat(np.arange(n_texts), np.diff(first))
    place = np.arange(len(starts)) + text * gap
    rows = np.full((len(starts) + n_texts * gap, len(shape.beginnings) + 1), -1, np.int32)
    for k, length in enumerate((*shape.beginnings, 1 << 30)):
        found = hashed(np.minimum(ends, starts + length))
        rows[place, k] = (found & np.uint64(shape.buckets - 1)).astype(np.int32) + k * shape.buckets
    return rows, first + np.arange(n_texts + 1) * gap


class ToxicityNet:
    """The network: embed, convolve, take the maximum of each filter, and weigh it."""

    def __init__(self, shape: Shape = Shape(), seed: int = 7):
        self.shape = shape
        draw = np.random.default_rng(seed)
        tables = len(shape.beginnings) + 1
        # The last row is the empty word, which row -1 names.
        self.words = draw.normal(0, 0.02, (tables * shape.buckets + 1, shape.dims)).astype(np.float32)
        self.words[-1] = 0
        self.kernels = [draw.normal(0, 0.5, (w * shape.dims, shape.filters)).astype(np.float32) for w in shape.widths]
        n = len(shape.widths) * shape.filters
        self.biases = np.zeros(n, np.float32)
        self.out = np.abs(draw.normal(0, 0.5, n)).astype(np.float32)
        self.out[::4] *= -1
        self.shift = np.full(1, -2.0, np.float32)
        # Adagrad's sums of squared gradients: one a word, and one for each other weight.
        self.word_squares = np.full(len(self.words), 1e-2, np.float32)
        self.squares = [np.full_like(w, 1e-2) for w in self.weights()]

    def weights(self) -> list[np.ndarray]:
        """All weights but the words'."""
        return [*self.kernels, self.biases, self.out, self.shift]

    def _embed(self, rows: np.ndarray) -> np.ndarray:
        # A row is taken as one value of all its bytes, which is much faster than by its numbers.
        whole = self.words.view(np.dtype((np.void, self.words.itemsize * self.shape.dims)))[:, 0]
        x = whole[rows[:, 0]].view(np.float32).reshape(-1, self.shape.dims)
        for k in range(1, rows.shape[1]):
            x += whole[rows[:, k]].view(np.float32).reshape(x.shape)
        return x

    def _pooled(self, x: np.ndarray, first: np.ndarray, arg: bool = False):
        """Largest value of each filter in each text, and where it is if asked."""
        tops, places = [], []
        for width, kernel in zip(self.shape.widths, self.kernels, strict=True):
            z = x @ kernel[: self.shape.dims]
            for o in range(1, width):
                z[:-o] += x[o:] @ kernel[o * self.shape.dims : (o + 1) * self.shape.dims]
            tops.append(np.maximum.reduceat(z, first[:-1], axis=0))
            if arg:
                places.append(np.array([a + z[a:b].argmax(axis=0) for a, b in zip(first[:-1], first[1:], strict=True)]))
        top = np.concatenate(tops, axis=1) + self.biases
        return (top, np.concatenate(places, axis=1)) if arg else top

    def logits(self, rows: np.ndarray, first: np.ndarray) -> np.ndarray:
        if len(first) < 2:
            return np.zeros(0)
        top = self._pooled(self._embed(rows), first)
        return (np.maximum(top, 0) @ self.out + self.shift).astype(np.float64)

    def learn(self, texts: pa.Array, labels: np.ndarray, turn: int, batch: int = 32, rate: float = 0.08) -> None:
        """One pass of Adagrad on the log loss, in an order that ``turn`` fixes.

        A step takes up to ``batch`` texts of like length, near STEP_BYTES together.
        """
        shape, dims = self.shape, self.shape.dims
        *kernel_squares, bias_squares, out_squares, shift_squares = self.squares
        sizes = pc.binary_length(texts).to_numpy()
        order = np.argsort(sizes, kind="stable")
        steps = _steps(sizes[order], batch)
        for b in np.random.default_rng((11, turn)).permutation(len(steps)):
            # Hashed anew: rows of all words would take several times the texts' own size.
            own_texts = order[slice(*steps[b])]
            rows, first = word_rows(*_bytes(texts.take(pa.array(own_texts))), shape)
            y = labels[own_texts].astype(np.float32)
            x = self._embed(rows)
            top, place = self._pooled(x, first, arg=True)
            active = np.maximum(top, 0)
            p = 1 / (1 + np.exp(-np.clip(active @ self.out + self.shift, -30, 30)))
            error = (p - y) / len(y)
            g_out = active.T @ error
            g_top = (error[:, None] * self.out) * (top > 0)
            reached, g_reached = [], []
            for k, (width, kernel) in enumerate(zip(shape.widths, self.kernels, strict=True)):
                own = slice(k * shape.filters, (k + 1) * shape.filters)
                at, g = place[:, own], g_top[:, own]
                g_kernel = np.zeros_like(kernel)
                for o in range(width):
                    part = slice(o * dims, (o + 1) * dims)
                    there = np.minimum(at + o, len(x) - 1)
                    g_kernel[part] = np.einsum("tf,tfd->df", g, x[there])
                    reached.append(there.ravel())
                    g_reached.append((g[:, :, None] * kernel[part].T[None]).reshape(-1, dims))
                kernel_squares[k] += g_kernel**2
                kernel -= rate * g_kernel / np.sqrt(kernel_squares[k])
            last = ((self.out, out_squares, g_out), (self.biases, bias_squares, g_top.sum(axis=0)))
            for weights, squares, g in (*last, (self.shift, shift_squares, error.sum())):
                squares += g**2
                weights -= rate * g / np.sqrt(squares)
            used, back = np.unique(np.concatenate(reached), return_inverse=True)
            g_used = np.zeros((len(used), dims), np.float32)
            np.add.at(g_used, back, np.concatenate(g_reached))
            for k in range(rows.shape[1]):
                names = rows[used, k]
                seen, back = np.unique(names[names >= 0], return_inverse=True)
                g = np.zeros((len(seen), dims), np.float32)
                np.add.at(g, back, g_used[names >= 0])
                self.word_squares[seen] += (g**2).mean(axis=1)
                self.words[seen] -= rate * g / np.sqrt(self.word_squares[seen])[:, None]

    def changes(self, before: ToxicityNet, shard: int) -> pa.Table:
        """What differs from ``before``: a row for each slice of the words, one for the other weights."""
        words = np.flatnonzero(self.word_squares != before.word_squares).astype(np.int32)
        ends = np.searchsorted(words, np.arange(SLICES + 1) * len(self.words) / SLICES)
        new, old = _flat(self.weights()), _flat(before.weights())
        out = [_change(-1, shard, np.arange(len(new), dtype=np.int32), new - old, _flat(self.squares) - _flat(before.squares))]
        for k in range(SLICES):
            own = words[ends[k] : ends[k + 1]]
            if len(own):
                squares = self.word_squares[own] - before.word_squares[own]
                out.append(_change(k, shard, own, self.words[own] - before.words[own], squares))
        return pa.Table.from_pylist(out, CHANGES)

    def add(self, changes: pa.Table) -> None:
        """Move each weight by its mean change over the copies that changed it."""
        for row in changes.to_pylist():
            names, counts, weights, squares = (np.frombuffer(row[c], t) for c, t in CHANGED.items())
            weights = weights.reshape(len(names), -1) / counts[:, None]
            if row["slice"] >= 0:
                self.words[names] += weights
                self.word_squares[names] += squares / counts
                continue
            ends = np.cumsum([w.size for w in self.weights()])[:-1]
            for own, sums, w, s in zip(
                self.weights(), self.squares, np.split(weights[:, 0], ends), np.split(squares / counts, ends), strict=True
            ):
                own += w.reshape(own.shape)
                sums += s.reshape(own.shape)


# Changes of weights: their names, by how many copies, and the sums over these copies.
CHANGED = {"names": np.int32, "counts": np.int32, "weights": np.float32, "squares": np.float32}
CHANGES = pa.schema([("slice", pa.int32()), ("shard", pa.int32()), *((c, pa.binary()) for c in CHANGED)])
CHANGES_DDL = "slice int, shard int, " + ", ".join(f"{c} binary" for c in CHANGED)


def _flat(arrays: list[np.ndarray]) -> np.ndarray:
    return np.concatenate([a.ravel() for a in arrays])


def _change(part: int, shard: int, names: np.ndarray, weights: np.ndarray, squares: np.ndarray, counts: np.ndarray | None = None) -> dict:
    counts = np.ones(len(names), np.int32) if counts is None else counts
    values = zip(CHANGED.items(), (names, counts, weights, squares), strict=True)
    return {"slice": part, "shard": shard, **{c: v.astype(t).tobytes() for (c, t), v in values}}


def _summed(key: tuple, changes: pa.Table) -> pa.Table:
    """One row for the changes of one slice by several copies, added in the order of the shards."""
    part, group = (k.as_py() for k in key)
    columns = changes.sort_by("shard").to_pydict()
    names, counts, weights, squares = (np.concatenate([np.frombuffer(b, t) for b in columns[c]]) for c, t in CHANGED.items())
    weights = weights.reshape(len(names), -1)
    seen, back = np.unique(names, return_inverse=True)
    sums = [np.bincount(back, v, len(seen)) for v in (counts, squares, *weights.T)]
    return pa.Table.from_pylist([_change(part, group, seen, np.stack(sums[2:], axis=1), sums[1], sums[0])], CHANGES)


def _bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return column_bytes(pc.utf8_lower(texts))


def _steps(sizes: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Runs of at most ``most`` texts, near STEP_BYTES together; a longer text is a run of its own."""
    ends = np.concatenate(([0], np.cumsum(sizes)))
    out, start = [], 0
    while start < len(sizes):
        end = int(np.searchsorted(ends, ends[start] + STEP_BYTES, side="right")) - 1
        end = min(max(end, start + 1), start + most, len(sizes))
        out.append((start, end))
        start = end
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


class ToxicityModel(NamedTuple):
    net: ToxicityNet
    thresholds: dict[str, float]

    def scores(self, column: pa.Array) -> np.ndarray:
        data, offsets = column_bytes(pc.utf8_lower(column.fill_null("")))
        return _sigmoid(self.net.logits(*word_rows(data, offsets, self.net.shape)))


def best_threshold(scores: np.ndarray, labels: np.ndarray, least: int = 10, counts: np.ndarray | None = None) -> float:
    """The score from which on F1 is best; 0.5 where one class has too few rows to tell.

    With ``counts``, a score stands for that many rows, and its label is the number of ones among them.
    """
    counts = np.ones(len(scores), np.int64) if counts is None else counts
    if min(labels.sum(), counts.sum() - labels.sum()) < least:
        return 0.5
    order = np.argsort(-scores, kind="stable")
    s, hits = scores[order], np.cumsum(labels[order])
    f1 = 2 * hits / (np.cumsum(counts[order]) + labels.sum())
    f1[:-1][s[:-1] == s[1:]] = -1
    k = int(np.argmax(f1))
    return float((s[k] + s[k + 1]) / 2) if k + 1 < len(s) else float(s[k])


def _learner(shared: Broadcast, turn: int) -> Callable[[tuple, pa.Table], pa.Table]:
    """What a copy of the network changes while it passes over one shard."""

    def learn(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([(c, "ascending") for c in ("mark", "doc_id", "text")])
        net = deepcopy(shared.value)
        net.learn(rows["text"].cast(pa.large_string()).combine_chunks(), rows["toxic"].to_numpy(), turn)
        return net.changes(shared.value, key[0].as_py())

    return learn


def fit_net(rows: DataFrame, rounds: int = 6, seed: int = 7, shard_bytes: int = SHARD_BYTES) -> ToxicityNet:
    """A network that learns from every row: doc_id, text, toxic, mark.

    Rows are dealt by their mark into shards near ``shard_bytes``. In each round a copy
    of the network passes over each shard, and the copies' changes are averaged, by weight, over
    those that changed it. Without two classes every score is the share of the toxic class.
    """
    n, ones, size = rows.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0)), F.sum(F.octet_length("text"))).first()
    net = ToxicityNet(seed=seed)
    if ones in (0, n):
        net.out[:] = 0
        share = ones / n if n else 0.0
        net.shift[:] = np.log(max(share, 1e-9) / max(1 - share, 1e-9))
        return net
    shards = max(1, round(size / shard_bytes))
    # Twice as many partitions as shards, as some get several.
    dealt = rows.withColumn("shard", F.pmod("mark", F.lit(shards)).cast("int")).repartition(2 * shards, "shard")
    context = rows.sparkSession.sparkContext
    for turn in range(rounds):
        shared = context.broadcast(net)
        changes, left = dealt.groupBy("shard").applyInArrow(_learner(shared, turn), CHANGES_DDL), shards
        while left > 1:
            groups = changes.groupBy("slice", F.floor(F.col("shard") / FAN).cast("int").alias("group"))
            changes, left = groups.applyInArrow(_summed, CHANGES_DDL), -(-left // FAN)
        net.add(changes.toArrow())
        shared.destroy()
    return net


def train_toxicity(
    docs: DataFrame, labels: DataFrame, rounds: int = 6, seed: int = 7, shard_bytes: int = SHARD_BYTES
) -> ToxicityModel:
    """Fit on all labelled documents and calibrate a threshold for each language.

    labels: doc_id, toxic. Every labelled row teaches the network. The thresholds come from
    every labelled row too, scored by a network that learnt from the other half alone.
    Rows with a null id, label or text teach nothing; without two classes every
    score is the share of the toxic class (0 without labels).
    """
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    given = docs.select("doc_id", "text", F.coalesce("lang", F.lit("")).alias("lang")).where("text IS NOT NULL")
    rows = written(
        given.join(known, "doc_id").select(
            "doc_id",
            "text",
            "lang",
            (F.col("toxic") > 0).cast("int").alias("toxic"),
            F.xxhash64(F.lit(seed), "doc_id", "text").alias("mark"),
            F.pmod(F.xxhash64(F.lit(seed + 1), "doc_id"), F.lit(2)).alias("fold"),
        )
    )
    model = ToxicityModel(fit_net(rows.drop("lang", "fold"), rounds, seed, shard_bytes), {})
    classes = rows.groupBy("fold").agg(F.countDistinct("toxic")).collect()
    if len(classes) < 2 or min(c for _, c in classes) < 2:
        return model
    for lang, counted in _out_of_fold(rows, rounds, seed, shard_bytes):
        logits, n, ones = np.array(sorted(counted)).T
        model.thresholds[lang] = float(_sigmoid(best_threshold((logits + 0.5) / LOGIT_STEPS, ones, counts=n)))
    return model


def _out_of_fold(rows: DataFrame, rounds: int, seed: int, shard_bytes: int, least: int = 10) -> list:
    """For each language with ``least`` rows of both classes: steps of the logit, their rows and ones."""
    parts = []
    for fold in (0, 1):
        net = fit_net(rows.where(F.col("fold") != fold).drop("lang", "fold"), rounds, seed, shard_bytes)
        own = rows.where(F.col("fold") == fold).select("text", "lang", "toxic")
        parts.append(score_toxicity(own, ToxicityModel(net, {})).select("lang", "toxic", "score"))
    score = F.least(F.greatest("score", F.lit(1e-9)), F.lit(1 - 1e-9))
    step = F.floor(F.log(score / (1 - score)) * LOGIT_STEPS).alias("step")
    steps = parts[0].unionAll(parts[1]).groupBy("lang", step).agg(F.count("*").alias("n"), F.sum("toxic").alias("ones"))
    enough = F.least(F.sum("ones"), F.sum(F.col("n") - F.col("ones"))) >= least
    languages = steps.groupBy("lang").agg(F.collect_list(F.struct("step", "n", "ones")).alias("steps"), enough.alias("enough"))
    return sorted((r.lang, r.steps) for r in languages.where("enough").collect())


def score_toxicity(docs: DataFrame, model: ToxicityModel, text: str = "text", out: str = "score") -> DataFrame:
    """Add a score to each document, from its whole text alone.

    A null or empty text, and one without words, gets the score of no word.
    Repeated rows score alike. A column named ``out`` is replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    given = docs.select(*[c for c in docs.columns if c != out])
    schema = StructType([*given.schema.fields, StructField(out, DoubleType())])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, text, STEP_BYTES):
            scores = shared.value.scores(batch.column(text))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores)], [*batch.schema.names, out])

    return given.mapInArrow(score, schema)


def reject_toxic(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """The documents whose score stays below the threshold of their language.

    Languages that the labels do not cover, and a null one, take 0.5.
    """
    limit = F.lit(0.5)
    for lang, at in sorted(model.thresholds.items()):
        limit = F.when(F.coalesce("lang", F.lit("")) == lang, F.lit(at)).otherwise(limit)
    return score_toxicity(docs, model, out="__score").where(F.col("__score") < limit).drop("__score")
