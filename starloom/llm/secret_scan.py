"""Secret scan: candidate strings, and a random forest that removes false positives."""

from __future__ import annotations

import math
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from starloom.llm.common import column_bytes, row_key, text_slices, written

CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
# Words before a value that speak for a credential.
CREDENTIAL_WORDS = frozenset(("token", "key", "apikey", "secret", "password", "passwd", "pwd", "auth", "bearer", "credential"))
# What such a word is assigned: any signs but white space and quotes, four or more. The sign is sought first, as it is
# rare; a run of signs is taken whole, and a value read only behind a credential word, so each character is seen once.
_SIGN = re.compile(r"[:=]++>?[ \t]*+[\"'`]?")
_VALUE = re.compile(r"[^\s\"'`<>=:][^\s\"'`<>]{3,}+")
_NAMED = re.compile(r"(?<![A-Za-z])(?:" + "|".join(sorted(CREDENTIAL_WORDS)) + r")[\"'`]?[ \t]*$", re.IGNORECASE)
_CLOSING = ",;.)]}"
# What may stand before the sign: the end of such a word, a quote or a blank.
_LAST = frozenset("".join(w[-1] + w[-1].upper() for w in CREDENTIAL_WORDS) + "\"'` \t")
_BEFORE = re.compile(r"([A-Za-z]+)?([^A-Za-z\n]*)$")
_WORD = re.compile(r"[a-z]+")
# Words beside a value that speak for something public.
PUBLIC_WORDS = frozenset(("sha", "md", "hash", "commit", "checksum", "digest", "etag", "uuid", "id", "request", "revision", "version", "page", "link", "path", "file", "title", "example"))
# Parts of a path that speak for made-up values.
_TRIAL_PATH = re.compile(r"(?:^|[/_.-])(?:tests?|specs?|examples?|samples?|fixtures?|docs?|mocks?)(?:[/_.-]|$)", re.IGNORECASE)
_CONFIG_PATH = re.compile(r"\.(?:env|ya?ml|json|toml|ini|cfg|conf|properties|py|js|ts|java|go|rb|sh|tf)$", re.IGNORECASE)
NEAR = 60  # characters on either side that hold the neighbouring words
GRAM_BITS = 18

FEATURES = (
    "length",
    "digits",
    "uppers",
    "signs",
    "transitions",
    "entropy",
    "vowels",
    "coverage",
    "credential",
    "assigned",
    "quoted",
    "secret_words",
    "public_words",
    "trial_path",
    "config_path",
)


def _gram_buckets(data: np.ndarray) -> np.ndarray:
    """Bucket of every four bytes in a row."""
    if len(data) < 4:
        return np.zeros(0, np.int64)
    x = (data | 0x20).astype(np.uint64)
    packed = x[:-3] | x[1:-2] << np.uint64(8) | x[2:-1] << np.uint64(16) | x[3:] << np.uint64(24)
    return ((packed * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - GRAM_BITS)).astype(np.int64)


def common_grams(docs: DataFrame, share: float = 2e-6, least: int = 5) -> tuple[np.ndarray, int]:
    """Which four-letter buckets are common in the corpus, and how many texts it has; counted over all of them.

    Common is what stands there ``least`` times, and is ``share`` of all.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, texts = np.zeros(1 << GRAM_BITS, np.int64), 0
        for batch in text_slices(batches):
            texts += batch.num_rows - batch.column("text").null_count
            data, _ = column_bytes(batch.column("text"))
            letters = ((data | 0x20) >= 0x61) & ((data | 0x20) <= 0x7A)
            inside = letters[:-3] & letters[1:-2] & letters[2:-1] & letters[3:]
            counts += np.bincount(_gram_buckets(data)[inside], minlength=len(counts))
        own = np.flatnonzero(counts)
        # Bucket -1 holds the texts.
        rows = [np.append(own, -1).astype(np.int32), np.append(counts[own], texts)]
        yield pa.RecordBatch.from_arrays([pa.array(r) for r in rows], ["bucket", "n"])

    sums = docs.select("text").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros((1 << GRAM_BITS) + 1, np.int64)  # one number a bucket, the texts last
    counts[sums["bucket"].to_numpy()] = sums["n"].to_numpy()
    counts, texts = counts[:-1], int(counts[-1])
    return (counts > share * counts.sum()) & (counts >= least), texts


def spans(text: str) -> list[tuple[int, int]]:
    """Where candidates start and end: assigned values, and long runs that overlap none of them."""
    out, behind = [], 0
    for found in _SIGN.finditer(text):
        low = found.end()
        at = found.start()
        if low < behind or text[at - 1 : at] not in _LAST or not _NAMED.search(text[max(0, at - 40) : at]):
            continue
        value = _VALUE.match(text, low)
        if value is None:
            continue
        behind = value.end()
        high = low + len(value[0].rstrip(_CLOSING))
        if high - low >= 4:
            out.append((low, high))
    given = [*out, (len(text) + 1, len(text) + 1)]
    at = 0
    for found in CANDIDATE.finditer(text):
        while given[at][1] <= found.start():
            at += 1
        if given[at][0] >= found.end():
            out.append(found.span())
    return sorted(out)


def describe(text: str, start: int, end: int, source: str | None, common: np.ndarray) -> tuple[float, ...]:
    """Features of a candidate: its signs, its words' share, the words on both sides, its path."""
    value = text[start:end]
    data = np.frombuffer(value.encode(), np.uint8)
    digit = (data >= 0x30) & (data <= 0x39)
    upper = (data >= 0x41) & (data <= 0x5A)
    lower = (data >= 0x61) & (data <= 0x7A)
    kind = digit + 2 * upper + 3 * lower
    vowels = np.isin(data | 0x20, (0x61, 0x65, 0x69, 0x6F, 0x75)) & (upper | lower)
    share = np.unique(data, return_counts=True)[1] / len(data)
    grams = _gram_buckets(data)
    before, after = text[max(0, start - NEAR) : start], text[end : end + NEAR]
    word, between = _BEFORE.search(before[-40:]).groups()
    beside = _WORD.findall(f"{before} {after}".lower())
    path = source or ""
    return (
        float(len(data)),
        float(digit.mean()),
        float(upper.mean()),
        float((kind == 0).mean()),
        float((kind[1:] != kind[:-1]).mean()),
        float(-(share * np.log2(share)).sum()),
        float(vowels.mean()),
        float(common[grams].mean()) if len(grams) else 0.0,
        float((word or "").lower() in CREDENTIAL_WORDS),
        float("=" in between or ":" in between),
        float(between[-1:] in ('"', "'")),
        float(sum(w in CREDENTIAL_WORDS for w in beside)),
        float(sum(w in PUBLIC_WORDS for w in beside)),
        float(bool(_TRIAL_PATH.search(path))),
        float(bool(_CONFIG_PATH.search(path))),
    )


def _findings(ids, rows: list[tuple], names: tuple[tuple[str, pa.DataType], ...]) -> pa.RecordBatch:
    kinds = [*[pa.float64()] * len(FEATURES), *(kind for _, kind in names)]
    columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
    return pa.RecordBatch.from_arrays([ids, *columns], ["doc_id", *FEATURES, *(name for name, _ in names)])


_NUMBERS = ", ".join(f"{c} double" for c in FEATURES)


def find_candidates(docs: DataFrame, common: np.ndarray) -> DataFrame:
    """Every candidate of every whole text, with its features, place and value.

    Candidates are values of four or more signs that a credential word is
    assigned, and elsewhere runs of 16 or more letters, digits and ``+/_=-``.
    """
    shared = docs.sparkSession.sparkContext.broadcast(common)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            rows, owner = [], []
            texts, sources = batch.column("text").to_pylist(), batch.column("source").to_pylist()
            for n, (text, source) in enumerate(zip(texts, sources, strict=True)):
                for start, end in spans(text or ""):
                    rows.append((*describe(text, start, end, source, shared.value), start, text[start:end]))
                    owner.append(n)
            if rows:
                ids = batch.column("doc_id").take(pa.array(owner, pa.int64()))
                yield _findings(ids, rows, (("start", pa.int64()), ("value", pa.string())))

    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "source")
    return given.mapInArrow(run, f"doc_id long, {_NUMBERS}, start long, value string")


# --- labelled findings -------------------------------------------------------------

_HEX, _DIGITS = "0123456789abcdef", "0123456789"
_LOWERS = "abcdefghijklmnopqrstuvwxyz"
_UPPERS = _LOWERS.upper()
_LETTERS = _LOWERS + _UPPERS
_FILLERS = ("the", "value", "of", "this", "service", "and", "then", "for", "user")
_ASSIGN = (" = ", "=", ": ", ":", '": "', " := ", " => ", "='", ' = "')


def _signs(draw: random.Random, signs: str, least: int, most: int | None = None) -> str:
    return "".join(draw.choices(signs, k=draw.randint(least, most or least)))


def _key(draw: random.Random) -> str:
    """A key whose own form tells it: a prefix, or signs of every kind at random."""
    return draw.choice(
        (
            lambda: draw.choice(("AKIA", "ASIA")) + _signs(draw, _UPPERS + _DIGITS, 16),
            lambda: draw.choice(("ghp_", "gho_", "npm_", "glpat-", "hf_")) + _signs(draw, _LETTERS + _DIGITS, 20, 36),
            lambda: draw.choice(("sk_live_", "rk_live_", "sk-", "xoxb-")) + _signs(draw, _LETTERS + _DIGITS, 24, 48),
            lambda: "AIza" + _signs(draw, _LETTERS + _DIGITS + "_-", 35),
            lambda: "eyJ" + _signs(draw, _LETTERS + _DIGITS + "_-", 30, 120),
            lambda: _signs(draw, _LETTERS + _DIGITS + "+/", 32, 64) + draw.choice(("", "=", "==")),
            lambda: _signs(draw, _LETTERS + _DIGITS, 20, 40),
        )
    )()


def _password(draw: random.Random) -> str:
    """Only the word before tells it."""
    return draw.choice(
        (
            lambda: _signs(draw, _LETTERS, 3, 7) + _signs(draw, _DIGITS, 1, 4) + _signs(draw, _LETTERS + "!@#$%&*.?", 2, 6),
            lambda: _signs(draw, _LETTERS + _DIGITS + "!@#$%&*.?-_", 8, 20),
            lambda: _hexes(draw),
        )
    )()


def _hexes(draw: random.Random) -> str:
    return _signs(draw, draw.choice((_HEX, _HEX.upper())), draw.choice((16, 32, 40, 64)))


def _name(draw: random.Random, words: list[str]) -> str:
    """What reads as words: identifiers, slugs, paths, words run together."""
    some = [draw.choice(words).lower() for _ in range(draw.randint(2, 6))]
    return draw.choice(
        (
            lambda: "".join([some[0], *(w.title() for w in some[1:])]),
            lambda: draw.choice("_-").join(some),
            lambda: f"{draw.randint(1990, 2030)}/{draw.randint(1, 12):02d}/" + "-".join(some) + draw.choice(("", f"-{draw.randint(0, 99)}")),
            lambda: "/".join(some),
            lambda: "".join(some),
            lambda: "".join(some).title(),
            lambda: "_".join(some).upper(),
        )
    )()


def _public(draw: random.Random) -> str:
    """Random signs that are no secret: numbers, UUIDs, rulers."""
    return draw.choice(
        (
            lambda: _signs(draw, _DIGITS, 16, 24),
            lambda: "-".join(_signs(draw, _HEX, n) for n in (8, 4, 4, 4, 12)),
            lambda: draw.choice("=-_+") * draw.randint(16, 80),
        )
    )()


def plant(draw: random.Random, around: str, source: str | None, common: np.ndarray) -> Iterator[tuple]:
    """Features, value, label and kind of findings put into a place of a text.

    Each value is written between the words that stand there, with or without a
    word before it, and described as the candidate that the search finds there.
    """
    cut = draw.randint(0, len(around))
    # Words that speak for either side stand near any kind of value.
    stray = lambda: draw.choice(("", "", "", draw.choice(sorted(CREDENTIAL_WORDS)), draw.choice(sorted(PUBLIC_WORDS))))
    before, after = f"{around[:cut]} {stray()}", f"{stray()} {around[cut:]}"
    words = re.findall(r"[A-Za-z]{3,12}", around) or list(_FILLERS)
    credential = draw.choice(sorted(CREDENTIAL_WORDS))
    named = draw.choice((credential, credential.upper(), credential.title(), f"api_{credential}", f"DB_{credential}".upper()))
    named += draw.choice(_ASSIGN)
    beside = draw.choice(sorted(PUBLIC_WORDS)) + draw.choice((" ", ": ", " = ", "-", ":"))
    other = draw.choice(words) + draw.choice((" ", " ", *_ASSIGN))
    dummy = draw.choice(("changeme", "your_key_here", "xxxxxxxxxxxxxxxx", "REPLACE_ME_WITH_KEY", "insert-token-here", "placeholder"))
    trial = draw.choice(("tests/fixtures/keys.py", "docs/examples/config.yml", "spec/sample.env"))
    config = draw.choice(("deploy/prod.env", "conf/app.yml", "src/main.py", source))
    for kind, lead, value, label, path in (
        ("key named", named, _key(draw), 1, draw.choice((source, config, trial))),
        ("key alone", draw.choice((other, "", '"')), _key(draw), 1, draw.choice((source, config, trial))),
        ("password", named, _password(draw), 1, draw.choice((source, config))),
        ("name named", named, _name(draw, words), 0, draw.choice((source, config))),
        ("name", draw.choice((other, beside, "")), _name(draw, words), 0, draw.choice((source, config, trial))),
        ("public", draw.choice((other, beside, "")), _public(draw), 0, draw.choice((source, config, trial))),
        ("hex named", named, _hexes(draw), 1, draw.choice((source, config))),
        ("hash", beside, _hexes(draw), 0, draw.choice((source, config))),
        ("dummy", named, dummy, 0, draw.choice((source, trial))),
        ("trial", named, _password(draw), 0, trial),
    ):
        close = lead[-1] if lead[-1:] in ('"', "'") else ""
        text = f"{before} {lead}{value}{close} {after}"
        low = len(before) + 1 + len(lead)
        for start, end in spans(text):
            if start < low + len(value) and end > low:
                yield (*describe(text, start, end, path, common), text[start:end], label, kind)


def planted_findings(docs: DataFrame, common: np.ndarray, texts: int, carriers: int = 500, rounds: int = 1000) -> DataFrame:
    """Labelled findings (features, value, label, kind): made-up values put into places of the corpus.

    About ``carriers`` of the texts, those of the smallest hash, lend their words (all of
    them where there are fewer); ``rounds`` places in all.
    """
    shared = docs.sparkSession.sparkContext.broadcast(common)
    each = math.ceil(rounds / max(1, min(texts, carriers)))
    bound = int(-(1 << 63) + min(1.0, carriers / max(1, texts)) * ((1 << 64) - 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            columns = (batch.column(c).to_pylist() for c in ("doc_id", "doc", "text", "source"))
            for doc_id, doc, text, source in zip(*columns, strict=True):
                draw, rows = random.Random(doc), []
                for _ in range(each):
                    at = draw.randint(0, max(0, len(text) - 2 * NEAR))
                    rows.extend(plant(draw, text[at : at + 2 * NEAR], source, shared.value))
                ids = pa.array([doc_id] * len(rows), pa.int64())
                yield _findings(ids, rows, (("value", pa.string()), ("label", pa.int32()), ("kind", pa.string())))

    given = docs.where("text IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), row_key().alias("doc"), "text", "source")
    chosen = given.where(F.col("doc") <= F.lit(min(bound, (1 << 63) - 1)))
    return chosen.mapInArrow(run, f"doc_id long, {_NUMBERS}, value string, label int, kind string")


def train_forest(findings: DataFrame, most_rows: int = 4000, trees: int = 30, depth: int = 10, seed: int = 3):
    """A forest from labelled findings (features, value, label); None unless both classes occur.

    Of each class at most ``most_rows`` findings are taken, those of the smallest
    hash of their value; a value is taken once for each label.
    """
    known = findings.where("label IS NOT NULL").withColumn("mark", F.xxhash64("value"))
    one = known.groupBy("label", "mark").agg(*[F.max(c).alias(c) for c in FEATURES])
    counts = {r[0]: r[1] for r in one.groupBy("label").count().collect()}
    if len(counts) < 2:
        return None
    # Only marks below a bound reach the sort, so it never sees all findings of a class.
    low = F.lit(False)
    for label, n in counts.items():
        bound = int(-(1 << 63) + min(1.0, 2 * most_rows / n) * ((1 << 64) - 1))
        low = low | ((F.col("label") == label) & (F.col("mark") <= F.lit(min(bound, (1 << 63) - 1))))
    order = Window.partitionBy("label").orderBy("mark")
    sample = one.where(low).withColumn("n", F.row_number().over(order)).where(F.col("n") <= most_rows)
    rows = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(sample)
    forest = RandomForestClassifier(
        labelCol="label", featuresCol="features", numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy="sqrt"
    )
    return forest.fit(rows.select("features", F.col("label").cast("double").alias("label")))


def score_findings(findings: DataFrame, forest) -> DataFrame:
    """The findings with ``score``, the forest's vote that they are secrets."""
    rows = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(findings)
    scored = forest.transform(rows).withColumn("score", vector_to_array("probability")[1])
    return scored.select(*findings.columns, "score")


def scan_secrets(docs: DataFrame, labelled: DataFrame | None = None, threshold: float = 0.5) -> DataFrame:
    """(doc_id, start, length, value, score, is_secret) for every candidate.

    labelled: findings with the features, a value and a label. By default
    made-up values with a known label are put into places of the corpus's own texts; of
    these a bounded sample trains the forest. Where only one class is labelled
    the forest cannot be grown, and every score is 0.
    start counts characters. Null and empty texts have no candidate; a null
    source is an empty path; a null id keeps its rows. Repeated rows are each
    scanned. Other columns are not read.
    """
    common, texts = common_grams(docs)
    candidates = find_candidates(docs, common)
    forest = train_forest(written(planted_findings(docs, common, texts)) if labelled is None else labelled)
    scored = candidates.withColumn("score", F.lit(0.0)) if forest is None else score_findings(candidates, forest)
    return scored.select(
        "doc_id", "start", F.length("value").cast("long").alias("length"), "value", "score", (F.col("score") >= threshold).alias("is_secret")
    )
