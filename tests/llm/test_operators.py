"""The training-data operators against brute force, on small tables and odd rows."""

import random
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from starloom.llm import decontaminate, line_dedup, ngram_join, packing, quality, secret_scan, sharding, suffix_dedup, toxicity
from starloom.llm.common import Forest, components
from starloom.llm.editing import best_substring, edit_distance
from starloom.llm.queries import QUERIES, URL_RULES, packing_tokenizer
from starloom.llm.url_filter import Rule, build_trie, filter_urls, longest_match

SMALL = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()}


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeated rows and ids, and columns named like added ones."""
    long = " ".join(f"w{i % 977}x{i % 31}" for i in range(30_000))
    rows = [
        (1, "One line with quite some words here.\nAnd then a second line of words.", "en", "a", 1),
        (1, "One line with quite some words here.\nAnd then a second line of words.", "en", "a", 1),
        (2, "one LINE with quite some words here!\nand then another line of its own", None, None, None),
        (3, None, "en", "a", 0),
        (4, "", "xx", "a", 0),
        (5, " \n\t ", "en", None, 4),
        (None, "A null id with a text of its own, which is kept.", "en", "a", 9),
        (None, "A null id with a text of its own, which is kept.", "en", "a", 9),
        (6, long, "en", "a", len(long)),
        (7, long + " end", "en", "a", len(long)),
        (8, "naïve Ünïcode <|endoftext|> \u2028 \x1c text\u00a0with 'quotes' and 12345", "de", "b", 3),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    for name in ("score", "leaks", "n_removed", "label", "doc", "words", "kept", "node", "bucket"):
        df = df.withColumn(name, F.lit("clash"))
    return df


def empty(spark, schema=SCHEMA):
    return spark.createDataFrame([], schema)


# --- shared ------------------------------------------------------------------


def test_components_against_union_find(spark):
    draw = random.Random(1)
    edges = [(draw.randrange(60), draw.randrange(60)) for _ in range(40)] + [(100 + i, 101 + i) for i in range(20)]
    forest = Forest()
    for a, b in edges:
        forest.union(a, b)
    found = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long").repartition(5)).collect()}
    assert found == {x: forest.find(x) for x in {n for e in edges for n in e} if forest.find(x) != x}


def test_edit_distance_against_table():
    def plain(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, last = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        return row[-1]

    draw = random.Random(2)
    for _ in range(200):
        a, b = ("".join(draw.choice("abc") for _ in range(draw.randrange(12))) for _ in range(2))
        assert edit_distance(a, b) == plain(a, b)
        if a and b:
            assert best_substring(a, b)[0] == min(plain(a, b[i:j]) for i in range(len(b) + 1) for j in range(i, len(b) + 1))


# --- 1 line dedup --------------------------------------------------------------


def lines_gone(docs, rule=line_dedup.LineRule()):
    """Lines that are not the first of their group, by the edit similarity of all pairs alone."""
    spots, sims = [], {}
    for i in sorted(docs):
        found, _, _ = line_dedup.find_lines(*line_dedup._normal(pa.array([docs[i]])), rule)
        lines = docs[i].split("\n")
        wanted = [k for k, line in enumerate(lines) if len(line_dedup.normal_line(line).split()) >= rule.least_words]
        assert found.line.tolist() == wanted
        for k, sim in zip(wanted, found.sim, strict=True):
            body = line_dedup.normal_line(lines[k])
            spots.append((i, k, body))
            assert sims.setdefault(body, sim) == sim
    forest, bodies = Forest(), list(sims)
    # An edit changes the counts of letters by two at most: what differs by more needs no comparison.
    counts = np.array([np.bincount(np.frombuffer(x.encode(), np.uint8), minlength=256) for x in bodies])
    sizes = np.array([len(x.encode()) for x in bodies])
    for a, x in enumerate(bodies):
        apart = np.abs(counts[:a] - counts[a]).sum(axis=1)
        for b in np.flatnonzero(apart * rule.down <= 2 * (rule.down - rule.up) * np.maximum(sizes[:a], sizes[a])).tolist():
            if rule.similar(x, bodies[b]):
                forest.union(x, bodies[b])
    seen, gone = set(), defaultdict(list)
    for i, k, body in spots:
        root = forest.find(body)
        if root in seen:
            gone[i].append(k)
        seen.add(root)
    return gone


@pytest.mark.parametrize("weight", [2_000_000, 400])
def test_lines_against_all_pairs(spark, docs, weight):
    """No line goes that all pairs would not remove, and of those at least nine in ten go."""
    docs = dict(docs)
    some = docs[max(docs)].split("\n")[0] + " and some more words to make it longer than it was before"
    for n in range(40):  # a group of near copies
        docs[10_000 + n] = some.replace("words", f"word{'s' * (n % 3)}") + " x" * (n % 5)
    gone, found, least = lines_gone(docs), 0, 0
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    for r in line_dedup.dedup_lines(df, block_weight=weight).collect():
        lines = docs[r.doc_id].split("\n")
        # Which lines are left: the text as a subsequence of the lines that were given.
        left, at = r.text.split("\n") if r.n_removed < r.n_lines else [], 0
        removed = []
        for k, line in enumerate(lines):
            if at < len(left) and line == left[at]:
                at += 1
            else:
                removed.append(k)
        assert at == len(left) and (r.n_lines, r.n_removed) == (len(lines), len(removed))
        if {lines[k] for k in removed} <= {lines[k] for k in gone[r.doc_id]}:
            found += len(removed)
        else:
            raise AssertionError((r.doc_id, removed, gone[r.doc_id]))
        least += len(gone[r.doc_id])
    assert found >= 0.9 * least


@pytest.mark.parametrize(("shortest", "longest"), [(5, 9), (10, 19), (20, 60)])
def test_lines_with_one_edit_are_candidates(spark, shortest, longest):
    """A word replaced, put in or left out, or a letter of it changed: nine in ten of the similar pairs join."""
    draw, rows, rule = random.Random(longest), [], line_dedup.LineRule()
    letters = "etaoinshrdlucmfw"
    word = lambda: "".join(draw.choice(letters) for _ in range(draw.randint(2, 9)))
    pairs = 0
    while pairs < 200:
        line = [word() for _ in range(draw.randint(shortest, longest))]
        other, at, how = list(line), draw.randrange(len(line)), draw.randrange(4)
        if how == 0:
            other[at] = word()
        elif how == 1:
            other.insert(at, word())
        elif how == 2 and len(line) > 5:
            del other[at]
        else:
            other[at] = draw.choice(letters) + other[at][1:]
        a, b = " ".join(line), " ".join(other)
        if a != b and rule.similar(a, b):
            rows += [(2 * pairs, a), (2 * pairs + 1, b)]
            pairs += 1
    left = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).where("n_removed = 1")
    ids = [r.doc_id for r in left.collect()]
    assert all(i % 2 for i in ids) and len(ids) >= 0.9 * pairs


def test_lines_of_odd_rows(spark, odd):
    rows = line_dedup.dedup_lines(odd).collect()
    assert len(rows) == odd.count()
    assert [r.text for r in rows if r.doc_id == 1] == [odd.first().text] * 2
    assert {r.text for r in rows if r.doc_id in (3, 4, 5)} == {None, "", " \n\t "}
    assert [r.text for r in rows if r.doc_id == 2] == ["and then another line of its own"]
    assert line_dedup.dedup_lines(empty(spark)).count() == 0


def test_documents_go_only_when_no_word_is_left(spark):
    notice = "This notice stands at the head of many files here."
    texts = {
        1: notice + "\nreturn a",
        2: notice + "\nroses red\nviolets blue\n\nso am I",
        3: f"{notice}\n--\n\n ...",
        4: notice,
        5: notice + "\né",
        6: "...",
        7: "",
        8: None,
    }
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    left = {r.doc_id: r.text for r in line_dedup.dedup_lines(df, drop_emptied=True).collect()}
    assert left == {1: texts[1], 2: "roses red\nviolets blue\n\nso am I", 5: "é", 6: "...", 7: "", 8: None}
    assert {r.doc_id for r in corpus_pipeline.line_dedup(spark, df, None).collect()} == {1, 2, 5, 6, 7, 8}


# --- 2 n-gram join ----------------------------------------------------------------


def jaccard_components(docs, words, up, down):
    sets = {}
    for i, t in docs.items():
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + words]) for k in range(len(w) - words + 1)} or ({tuple(w)} if w else set())
    forest = Forest()
    for a in sets:
        for b in sets:
            common = len(sets[a] & sets[b])
            if a < b and common and down * common >= up * (len(sets[a]) + len(sets[b]) - common):
                forest.union(a, b)
    return {i: (len(s), forest.find(i)) for i, s in sets.items()}


@pytest.mark.parametrize(("words", "up", "weight"), [(3, 90, 2_000_000), (3, 50, 2_000_000), (5, 80, 600)])
def test_join_against_all_pairs(spark, docs, words, up, weight):
    docs, draw = dict(docs), random.Random(3)
    base = " ".join(f"tok{draw.randrange(500)}" for _ in range(150)).split()
    for n in range(70):  # more near copies than a short run holds
        copy = list(base)
        for _ in range(n % 4):
            copy[draw.randrange(len(copy))] = f"new{n}"
        docs[10_000 + n] = " ".join(copy)
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    rows = ngram_join.ngram_components(df, ngram_join.Jaccard(words, up, 100), block_weight=weight).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == jaccard_components(docs, words, up, 100)


def test_join_of_odd_rows(spark, odd):
    rows = ngram_join.ngram_components(odd).collect()
    assert len(rows) == odd.count()
    got = {(r.doc_id, r.n_shingles > 0, r.component_id) for r in rows}
    assert {(3, False, 3), (4, False, 4), (5, False, 5), (None, True, None), (1, True, 1), (7, True, 6)} <= got
    kept = Counter(r.doc_id for r in ngram_join.keep_one(odd).collect())
    assert kept == Counter([1, 2, 3, 4, 5, 6, 8, None])
    assert ngram_join.ngram_components(empty(spark)).count() == ngram_join.keep_one(empty(spark)).count() == 0


# --- 3 secrets ----------------------------------------------------------------------


def test_secrets_found_and_words_left(spark):
    draw = random.Random(4)
    hexes = ["".join(draw.choice("0123456789abcdef") for _ in range(40)) for _ in range(60)]
    words = ["".join(draw.choice(("th", "an", "er", "ion", "ou")) for _ in range(10)) for _ in range(60)]
    rows = [(i, f'word word token = "{h}" and {w} then 1234567890123456', None) for i, (h, w) in enumerate(zip(hexes, words, strict=True))]
    rows += [(100, 'KEY: "9F86D081884C7D659A2FEAA0C55AD015A3BF4F1B"', "x"), (101, None, None), (102, "", "y"), (None, words[0], None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = secret_scan.scan_secrets(df).collect()
    assert {(r.doc_id, r.value) for r in found if r.is_secret} == {*enumerate(hexes), (100, rows[60][1][6:46])}
    assert all(rows[r.doc_id][1][r.start : r.start + r.length] == r.value for r in found if r.doc_id is not None and r.doc_id < 100)
    assert (None, words[0]) in {(r.doc_id, r.value) for r in found}
    assert secret_scan.scan_secrets(df.where("doc_id >= 101")).count() == 0


def test_short_and_signed_secrets_are_found_and_mixed_strings_left(spark):
    draw = random.Random(10)
    text = lambda signs, n: "".join(draw.choice(signs) for _ in range(n))
    rows, expected, uuids = [], set(), set()
    for i in range(60):
        short, odd = f"{text('abcdefgh', 4)}{i}{text('XYZ', 3)}", f"{text('abcdefgh', 5)}.{i}@{text('XYZ', 4)}!x"
        uuid = "-".join(text("0123456789abcdef", n) for n in (8, 4, 4, 4, 12))
        slug = f"2024/0{1 + i % 9}/some-{draw.choice(('old', 'new'))}-title-{i}"
        rows.append((i, f'password = "{short}" and {{"secret": "{odd}"}}, then request {uuid} for {slug} here', None))
        expected |= {(i, short), (i, odd)}
        uuids |= {(i, uuid), (i, slug)}
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = secret_scan.scan_secrets(df).collect()
    assert {(r.doc_id, r.value) for r in found if r.is_secret} == expected
    assert uuids <= {(r.doc_id, r.value) for r in found}
    assert all(rows[r.doc_id][1][r.start : r.start + r.length] == r.value for r in found)


def test_secrets_of_odd_rows(spark, odd):
    assert not secret_scan.scan_secrets(odd).where("is_secret").count()
    assert secret_scan.scan_secrets(empty(spark)).count() == 0


# --- 4 quality ------------------------------------------------------------------------


def plain_signals(text):
    words = [w.decode() for w in (text or "").encode().split()]
    lines = [x for x in (text or "").split("\n") if x.encode().split()]
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    hit = {i + k for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for k in range(8)}
    symbols = sum(c in "#*$%&|<>" for c in text or "")
    failed = len(words) < 20 or 100 * len(hit) > 30 * len(words)
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(hit), failed


def test_base_signals_against_plain_code(spark, docs, odd):
    for df in (spark.createDataFrame(list(docs.items()), "doc_id long, text string"), odd):
        names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
        for r in quality.base_signals(df).select("text", *names).collect():
            assert tuple(r)[1:] == plain_signals(r.text)


def test_ratio_keeps_prose_and_drops_junk(spark):
    rows = QUERIES["op4_quality_rules"](spark, "/root/testdata/sf0.01").join(
        spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id"
    )
    found = {(r.quality, r.kept): r["count"] for r in rows.where("NOT base_failed").groupBy("quality", "kept").count().collect()}
    assert found[1, True] > 0.97 * (found[1, True] + found.get((1, False), 0))
    assert found[0, False] > 0.8 * (found[0, False] + found.get((0, True), 0))


def test_quality_of_odd_rows(spark, odd):
    labels = empty(spark, "doc_id long, quality int")
    judged = quality.judge_quality(odd, labels).collect()
    assert len(judged) == odd.count() and all(r.kept == (not r.base_failed) for r in judged)
    assert quality.judge_quality(empty(spark), labels).count() == 0


# --- 5 packing -----------------------------------------------------------------------


def check_packing(spark, df, window):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(packing_tokenizer())
    expected = Counter((r.doc_id, tuple(whole.encode(r.text or "", add_special_tokens=False).ids + [2])) for r in df.collect())
    pieces = packing.pack_documents(df, packing_tokenizer(), window).collect()
    sequences = defaultdict(list)
    for p in pieces:
        assert len(p.ids) == 4 * p.length > 0
        sequences[p.sequence_id].append((p.offset, p.length))
    for parts in sequences.values():
        ends = [a + n for a, n in sorted(parts)]
        assert [a for a, _ in sorted(parts)] == [0, *ends[:-1]]
        assert ends[-1] == window or ends[-1] & (ends[-1] - 1) == 0
    texts = defaultdict(lambda: defaultdict(list))
    for p in pieces:
        texts[p.doc_id, p.doc_tokens][p.start].append(np.frombuffer(p.ids, "<u4").tolist())
    got = sum(len(ids) for by in texts.values() for parts in by.values() for ids in parts)
    assert got == sum(len(ids) * n for (_, ids), n in expected.items())
    for (doc, ids), _ in expected.items():
        for start, parts in texts[doc, len(ids)].items():
            assert any(tuple(part) == ids[start : start + len(part)] for part in parts)


def test_special_tokens_in_texts_get_their_ids(spark):
    from tokenizers import Tokenizer

    texts = ["a<|endoftext|>b <|endoftext|>", "<|startoftext|>'s x<|endof text|>", "<|ENDOFTEXT|>.<|endoftext|>漢字", "''<|endoftext|>'ll"]
    whole = Tokenizer.from_file(packing_tokenizer())
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = defaultdict(bytes)
    for p in sorted(packing.pack_documents(df, packing_tokenizer()).collect(), key=lambda p: p.start):
        got[p.doc_id] += bytes(p.ids)
    for n, text in enumerate(texts):
        assert np.frombuffer(got[n], "<u4").tolist() == [*whole.encode(text, add_special_tokens=False).ids, 2]
    assert 49407 in np.frombuffer(got[0], "<u4")


def test_remembered_words_are_bounded_by_their_bytes(monkeypatch):
    monkeypatch.setattr(packing, "KNOWN_BYTES", 100_000)
    words, fresh = packing.WordTokenizer(packing_tokenizer(), 2), packing.WordTokenizer(packing_tokenizer(), 2)
    # Scripts without blanks: each text is one long word of its own.
    texts = ["文" * 3000 + str(n) for n in range(40)] + ["plain words"] * 3
    for text in texts:
        words.encode([text])  # one text more than the bound may be held
        assert sum(len(k) + len(v) for k, v in words.known.items()) < 160_000
    assert words.encode(texts) == fresh.encode(texts)


@pytest.mark.parametrize("window", [4096, 64])
def test_packing_is_exact(spark, docs, odd, window):
    check_packing(spark, spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(3), window)
    check_packing(spark, odd, window)
    assert packing.pack_documents(empty(spark), packing_tokenizer()).count() == 0


def test_level_has_the_least_sum_of_squares():
    draw, packer = random.Random(5), packing.Packer(32)
    for n in range(400):
        size, before = draw.randrange(1, 32), packer.levels.copy()
        packer.add(n, b"\0" * 4 * size)

        def squares(level, size=size, before=before):
            after = before.copy()
            after[level] -= level > 0
            after[level + size] += level + size < 32
            return int((after[:32] ** 2).sum())

        best = min(squares(h) for h in range(32 - size + 1) if h == 0 or before[h])
        assert int((packer.levels[:32] ** 2).sum()) == best


@pytest.mark.parametrize("most_open", [2, 3, 8, 40])
def test_no_id_is_lost_where_open_windows_are_poured_together(monkeypatch, most_open):
    monkeypatch.setattr(packing, "MOST_OPEN", most_open)
    draw, packer, poured = random.Random(8), packing.Packer(32), 0
    given, got, filled = {}, defaultdict(list), Counter()
    for n in range(900):
        # Sizes just above half a window leave windows open: no two share one.
        given[n] = np.arange(draw.choice([17, 18, 19, 9, 3, 40, 1]), dtype="<u4") + 1000 * n
        poured += packer.n_open == most_open - 1
        packer.add(n, given[n].tobytes())
    packer.finish()
    assert poured
    for doc, start, length, total, sequence, _, ids in packer.take():
        assert total == len(given[doc]) and len(ids) == 4 * length > 0
        got[doc].append((start, np.frombuffer(ids, "<u4")))
        filled[sequence] += length
    assert got.keys() == given.keys()
    for n, pieces in got.items():
        pieces.sort(key=lambda x: x[0])
        ends = np.cumsum([len(ids) for _, ids in pieces])
        assert [start for start, _ in pieces] == [0, *ends[:-1]]
        assert np.array_equal(np.concatenate([ids for _, ids in pieces]), given[n])
    sizes = [filled[s] for s in sorted(filled)]
    assert all(n & (n - 1) == 0 for n in sizes) and sum(n < 32 for n in sizes) <= 5


# --- 6 urls --------------------------------------------------------------------------


def test_urls_longest_rule_wins(spark):
    trie = build_trie(URL_RULES)
    cases = {
        ("www.example.com", "/en/1"): ("allow", "www.example.com/en/"),
        ("m.example.com", "/en/1"): ("block", "example.com/en/"),
        ("m.example.com", "/en"): ("allow", "com/"),
        ("notexample.com", "/en/1"): ("allow", "com/"),
        ("a.net", "/fr/"): ("block", "net/fr/"),
        ("a.net", "/de/"): None,
        ("a.com", ""): None,
        ("", ""): None,
    }
    assert {k: longest_match(trie, *k) for k in cases} == cases
    with pytest.raises(ValueError):
        build_trie([Rule("allow", "a.b"), Rule("block", "A.B")])
    rows = [(1, "HTTP://WWW.Example.COM/en/x?a://b"), (2, None), (3, "no scheme/en/"), (None, "http://x.net/es/#é"), (None, "http://x.net/es/#é")]
    df = spark.createDataFrame(rows, "page_id long, url string").withColumn("host", F.lit(1))
    got = [(r.page_id, r.host, r.path, r.rule, r.verdict) for r in filter_urls(df, URL_RULES).collect()]
    last = (None, "x.net", "/es/", "net/es/", "block")
    assert got == [(1, "www.example.com", "/en/x", "www.example.com/en/", "allow"), (2, "", "", None, "allow"), (3, "", "", None, "allow"), last, last]


# --- 7 toxicity ----------------------------------------------------------------------


def test_toxicity_on_held_out_rows(spark):
    rows = QUERIES["op7_toxicity"](spark, "/root/testdata/sf0.1").join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id")
    held = rows.where("held_out").toPandas()
    bad, good = held[held.toxic == 1].score.to_numpy(), held[held.toxic == 0].score.to_numpy()
    assert np.mean(bad[:, None] > good[None]) > 0.95
    assert (good >= 0.5).mean() < 0.02 and ((0 <= held.score) & (held.score <= 1)).all()


def test_toxicity_of_odd_rows(spark, odd):
    labels = empty(spark, "doc_id long, toxic int")
    model = toxicity.train_toxicity(odd, labels)
    assert {r.score < 0.01 for r in toxicity.score_toxicity(odd, model).collect()} == {True}
    assert toxicity.reject_toxic(odd, model).columns == odd.columns
    model = toxicity.train_toxicity(odd, spark.createDataFrame([(1, 1), (2, 0), (3, 1), (None, 1), (6, None)], "doc_id long, toxic int"))
    assert toxicity.score_toxicity(odd, model).count() == odd.count()
    assert toxicity.score_toxicity(empty(spark), model).count() == 0
    assert toxicity.best_threshold(np.array([0.9, 0.8, 0.2, 0.1]), np.array([1, 1, 0, 0]), 2) == 0.5


def test_toxicity_learns_from_every_labelled_row(spark):
    """The toxic rows beyond the 6,000 with the smallest hash have a word of their own."""
    mark = F.expr("pmod(xxhash64(7, doc_id), 1 << 30)")
    toxic = [r.doc_id for r in spark.range(6600).select(F.col("id").alias("doc_id")).orderBy(mark, "doc_id").collect()]
    words = {i: "blarghest" if k < 6000 else "glorpious" for k, i in enumerate(toxic)}
    rows = [(i, f"some plain words {words.get(i, 'garden')} then more {i % 97}", "en") for i in range(9000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = docs.select("doc_id", F.expr("cast(doc_id < 6600 as int)").alias("toxic"))
    model = toxicity.train_toxicity(docs, labels, shard_bytes=1 << 17)
    score = {r.doc_id: r.score for r in toxicity.score_toxicity(docs, model).collect()}
    late = [i for i, word in words.items() if word == "glorpious"]
    assert len(late) == 600 and min(score[i] for i in late) > 0.5 > max(score[i] for i in range(6600, 9000))
    assert {r.doc_id for r in toxicity.reject_toxic(docs, model).collect()} == set(range(6600, 9000))


def test_pipeline_rejects_by_every_labelled_row(spark, tmp_path):
    """As above, by the stage: rows with the late word are beyond the 6,000 with the smallest hash."""
    mark = F.expr("pmod(xxhash64(7, doc_id), 1 << 30)")
    toxic = [r.doc_id for r in spark.range(6600).select(F.col("id").alias("doc_id")).orderBy(mark, "doc_id").collect()]
    words = {i: "blarghest" if k < 6000 else "glorpious" for k, i in enumerate(toxic)}
    rows = [(i, f"some plain words {words.get(i, 'garden')} then more {i % 97}", "en", "web", 40) for i in range(9000)]
    docs = spark.createDataFrame(rows, SCHEMA)
    docs.select("doc_id", F.expr("cast(doc_id < 6600 as int)").alias("toxic")).write.parquet(f"{tmp_path}/labels.parquet")
    kept = corpus_pipeline.toxicity(spark, docs, str(tmp_path))
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == set(range(6600, 9000))


def test_pipeline_counts_every_labelled_row_for_its_thresholds(spark, tmp_path, monkeypatch):
    """Rows and toxic ones by language, as the calibration of the stage gets them."""
    best, seen = toxicity.best_threshold, []

    def counted(scores, labels, *args, counts=None, **kwargs):
        seen.append((len(scores) if counts is None else int(counts.sum()), int(labels.sum())))
        return best(scores, labels, *args, **({} if counts is None else {"counts": counts}), **kwargs)

    monkeypatch.setattr(toxicity, "best_threshold", counted)
    rows = [(i, f"some plain words {'garden' if i % 3 else 'blarghest'}", "en" if i < 500 else "de", "web", 30) for i in range(800)]
    docs = spark.createDataFrame(rows, SCHEMA)
    docs.select("doc_id", F.expr("cast(doc_id % 3 = 0 as int)").alias("toxic")).write.parquet(f"{tmp_path}/labels.parquet")
    kept = corpus_pipeline.toxicity(spark, docs, str(tmp_path))
    assert {r.doc_id for r in kept.collect()} == {i for i in range(800) if i % 3}
    assert seen == [(300, 100), (500, 167)]


def test_toxicity_learns_alike_from_any_partitions(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60).repartition(3)
    labels = docs.select("doc_id", F.expr("cast(doc_id % 3 = 0 as int)").alias("toxic"))
    texts = [r.text for r in docs.collect()]
    size = sum(len(t.encode()) for t in texts) // 5
    models = [toxicity.train_toxicity(d, labels, rounds=2, shard_bytes=size) for d in (docs, docs.orderBy(F.desc("doc_id")))]
    first, second = (m.scores(pa.array(texts)) for m in models)
    assert (first == second).all() and len(set(first.tolist())) > 1 and models[0].thresholds == models[1].thresholds


def test_toxicity_thresholds_from_counted_scores():
    draw = np.random.default_rng(3)
    scores, labels = draw.integers(0, 30, 400) / 30, draw.integers(0, 2, 400)
    values, back = np.unique(scores, return_inverse=True)
    ones, counts = np.bincount(back, labels).astype(int), np.bincount(back)
    assert toxicity.best_threshold(values, ones, counts=counts) == toxicity.best_threshold(scores, labels)


def test_toxicity_copies_are_mixed_by_the_mean_of_those_that_changed():
    before = toxicity.ToxicityNet()
    copies = [toxicity.ToxicityNet() for _ in range(3)]
    for k, names in enumerate(([1, 5], [5], [200_000])):
        copies[k].words[names] += k + 1
        copies[k].word_squares[names] += 1
        copies[k].biases += 3 * k
    parts = [c.changes(before, k).to_pylist() for k, c in enumerate(copies)]
    by_slice = {}
    for row in sum(parts, []):
        by_slice.setdefault(row["slice"], []).append(row)
    net = toxicity.ToxicityNet()
    for part, rows in by_slice.items():
        net.add(toxicity._summed((pa.scalar(part), pa.scalar(0)), pa.Table.from_pylist(rows, toxicity.CHANGES)))
    moved = net.words - before.words
    assert np.allclose(moved[[1, 5, 200_000]], np.array([1, 1.5, 3])[:, None], atol=1e-6)
    assert np.count_nonzero(moved.any(axis=1)) == 3 and np.allclose(net.biases - before.biases, 3)


# --- 8 suffix arrays -------------------------------------------------------------------


def plain_repeats(docs, least=50):
    seen, out = {}, {}
    for i in sorted(docs):
        data = (docs[i] or "").encode()
        gone, own = bytearray(len(data)), set()
        for p in range(len(data) - least + 1):
            own.add(data[p : p + least])
            if data[p : p + least] in seen:
                gone[p : p + least] = b"\1" * least
        for s in own:
            seen.setdefault(s, i)
        rest = bytes(b for b, g in zip(data, gone, strict=True) if not g)
        out[i] = (len(data), sum(gone), (b"\0" + bytes(gone)).count(b"\0\1"), rest)
    return out


def test_repeats_against_a_set_of_strings(spark, docs):
    docs, draw = dict(docs), random.Random(6)
    for n in range(60):
        a, b = draw.choice(list(docs.values())), draw.choice(list(docs.values()))
        p, q = draw.randrange(len(a)), draw.randrange(len(b))
        docs[1000 + n] = f"{draw.random()}" + a[p : p + draw.randrange(40, 200)] + b[q : q + draw.randrange(40, 70)] + "ab" * draw.randrange(60)
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(4)
    rows = suffix_dedup.remove_repeats(df).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, len(r.spans), bytes(r.rest)) for r in rows} == plain_repeats(docs)


def test_maximal_repeats_against_all_substrings():
    texts = [b"abcabcabcx", b"zabcabcy", b"qqabcab"]
    offsets = np.cumsum([0, *map(len, texts)])
    array = suffix_dedup.SuffixArray(np.frombuffer(b"".join(texts), np.uint8), offsets, 3)
    places = lambda s: {(i, p) for i, t in enumerate(texts) for p in range(len(t)) if t.startswith(s, p)}
    expected = set()
    for t in texts:
        for a in range(len(t)):
            for b in range(a + 3, len(t) + 1):
                found = places(t[a:b])
                left = {texts[i][p - 1 : p] or i + 1 for i, p in found if p or True}
                right = {texts[i][p + b - a : p + b - a + 1] or i + 1 for i, p in found}
                starts = any(p == 0 for _, p in found)
                ends = any(p + b - a == len(texts[i]) for i, p in found)
                if len(found) > 1 and (len(left) > 1 or starts) and (len(right) > 1 or ends):
                    expected.add((b - a, frozenset(found)))
    got = set()
    for length, low, high in array.maximal_repeats():
        at = array.order[low:high]
        got.add((length, frozenset(zip(array.chunk[at].tolist(), array.offset[at].tolist(), strict=True))))
    assert got == expected


def test_repeats_of_odd_rows(spark, odd):
    rows = suffix_dedup.remove_repeats(odd).collect()
    assert len(rows) == odd.count()
    removed = {r.doc_id: r.n_removed for r in rows}
    size = {r.doc_id: r.n_bytes for r in rows}
    assert removed[None] == removed[1] == removed[3] == removed[6] == 0 and size[3] == 0
    assert 0 < removed[7] <= size[7] - 4
    assert suffix_dedup.remove_repeats(empty(spark)).count() == 0


def test_candidates_of_long_runs_are_found_in_linear_time():
    """A megabyte of one sign, of assignments without an end, or of blanks."""
    runs = ("=" * 1_000_000, "token:" + "=" * 1_000_000, "a=" * 500_000, "key=" * 250_000, "key = " + " " * 1_000_000, "key=a" + "=b" * 400_000)
    for text in runs:
        before = time.process_time()
        spans = secret_scan.spans(text)
        assert time.process_time() - before < 2
        assert all(0 <= a < b <= len(text) for a, b in spans)
    text = "key=ab12x, token: 'q9Qz'"
    assert [text[a:b] for a, b in secret_scan.spans(text)] == ["ab12x", "q9Qz"]
    text = "password:=>  s3cr=t:x "
    assert [text[a:b] for a, b in secret_scan.spans(text)] == ["s3cr=t:x"]


# --- 9 decontamination ---------------------------------------------------------------------


def test_leaks_found_and_clean_documents_left(spark, docs):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    draw, rows, expected = random.Random(7), [], set()
    clean = [t for t in docs.values() if not any(line_dedup.normal_line(i) in line_dedup.normal_line(t) for _, i in items)]
    for n, (item, text) in enumerate(items):
        edited = list(text)
        for _ in range(n % 4 * len(text) // 40):  # up to 7.5 % of the characters
            edited[draw.randrange(len(edited))] = draw.choice("xyz ")
        rows.append((n, f"{clean[n % len(clean)]} {''.join(edited).upper()} {clean[n * 7 % len(clean)]}"))
        expected.add((n, item))
    rows += [(1000 + n, t) for n, t in enumerate(clean)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = decontaminate.find_leaks(df, spark.createDataFrame(items, "item_id long, text string"))
    got = {(r.doc_id, leak.item_id) for r in found.collect() for leak in r.leaks}
    assert len(expected - got) <= 1 and not got - expected


def test_leaks_near_the_least_similarity_against_brute_force(spark, docs):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    normal = [(i, line_dedup.normal_line(t)) for i, t in items]
    draw, rows = random.Random(9), []
    for i, text in normal:
        for percent in (10, 15, 18, 20):  # characters replaced anywhere, as typos and OCR errors are
            edited = list(text)
            for at in draw.sample(range(len(text)), percent * len(text) // 100):
                edited[at] = draw.choice([c for c in "abcdefghij" if c != edited[at]])
            around = draw.choice(list(docs.values()))[:300]
            rows.append((1000 * i + percent, f"{around}\n{''.join(edited)}\n{around}"))
    expected = set()
    for doc, text in rows:
        whole = line_dedup.normal_line(text)
        expected |= {(doc, i) for i, t in normal if 5 * best_substring(t, whole)[0] <= len(t)}
    assert len(expected) >= len(rows) - 2
    found = decontaminate.find_leaks(
        spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    )
    got, texts = set(), dict(rows)
    for r in found.collect():
        for leak in r.leaks:
            got.add((r.doc_id, leak.item_id))
            words = line_dedup.normal_line(texts[r.doc_id]).split(" ")[leak.start : leak.end]
            assert 5 * best_substring(dict(normal)[leak.item_id], " ".join(words))[0] <= len(dict(normal)[leak.item_id])
    assert got <= expected and len(got) >= 0.98 * len(expected)


def test_leaks_with_evenly_spaced_edits(spark, docs):
    """One letter replaced in every six to ten: no run of bytes outlasts them, the windows are found all the same."""
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    draw, rows, normal = random.Random(13), [], {i: line_dedup.normal_line(t) for i, t in items}
    for i, text in items:
        for every in (6, 7, 8, 10):
            edited = "".join(draw.choice("xyz") if n % every == 2 and c.isalpha() else c for n, c in enumerate(text))
            if 5 * best_substring(normal[i], line_dedup.normal_line(edited))[0] <= len(normal[i]):
                rows.append((100 * i + every, f"{draw.choice(list(docs.values()))[:400]}\n{edited}"))
    found = decontaminate.find_leaks(
        spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    )
    got = {(r.doc_id, leak.item_id) for r in found.collect() for leak in r.leaks}
    assert len(rows) > 3 * len(items) and sum((d, d // 100) in got for d, _ in rows) >= 0.9 * len(rows)


def test_hashing_decides_which_windows_are_verified(spark, docs):
    """Of the windows that seeds lay in clean texts nearly all share no key with their item."""
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    index = decontaminate.BenchmarkIndex(items, decontaminate.LeakRule())
    given = [line_dedup.normal_line(i) for _, i in items]
    clean = [t for t in map(line_dedup.normal_line, docs.values()) if not any(best_substring(i, t)[0] * 5 <= len(i) for i in given[:8])]
    body = np.frombuffer(" ".join(clean).encode(), np.uint8)
    laid = [(r.item, w) for r in index.regions(body) for w in r.windows if w >= 0]
    which = np.array([i for i, _ in laid])
    windows = [body[w : w + int(index.sizes[i])].tobytes() for i, w in laid]
    met = index.collides(which, windows)
    far = [n for n, (i, w) in enumerate(zip(which.tolist(), windows, strict=True)) if edit_distance(w.decode("latin1"), index.encoded[i].decode("latin1")) > 0.4 * len(w)]
    assert len(far) >= 20 and met[far].mean() < 0.15
    # Any two strings that are equal share every key.
    assert index.collides(np.arange(len(index.encoded)), index.encoded).all()


def test_leaks_of_odd_rows(spark, odd):
    items = [(1, "a null id with a text of its own"), (2, None), (None, "one line with quite some words here"), (3, ""), (4, "two words")]
    found = decontaminate.find_leaks(odd, spark.createDataFrame(items, "item_id long, text string"))
    assert [[leak.item_id for leak in r.leaks] for r in found.where("size(leaks) > 0").collect()] == [[1], [1]]
    assert found.count() == odd.count()
    none = empty(spark, "item_id long, text string")
    assert decontaminate.remove_leaks(odd, none).columns == odd.columns
    assert decontaminate.find_leaks(empty(spark), none).count() == 0


# --- 10 sharding --------------------------------------------------------------------------


def check_shards(df, shards):
    rows = sharding.shard_documents(df, shards).collect()
    slots, sizes = defaultdict(list), Counter()
    for r in rows:
        slots[r.shard].append(r.slot)
        sizes[r.shard] += r.size
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(shards))
    given = Counter((r.doc_id, len((r.text or "").encode()) + 16, zlib.crc32((r.text or "").encode())) for r in df.collect())
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in rows) == given
    return sizes


def test_shards_are_near_equal_with_hot_groups(spark):
    draw = random.Random(8)
    rows = [(i, "x" * draw.randrange(200)) for i in range(3000)] + [(i, "hot text") for i in range(3000, 6000)]
    rows += [(None, "null")] * 50
    sizes = check_shards(spark.createDataFrame(rows, "doc_id long, text string"), 10)
    mean = sum(sizes.values()) / 10
    assert all(abs(s - mean) < 0.03 * mean for s in sizes.values())


def test_shards_of_odd_rows(spark, odd):
    check_shards(odd, 40)
    assert sharding.shard_documents(empty(spark)).count() == 0


# --- pipeline -----------------------------------------------------------------------------


def test_stages_keep_columns_and_survive_odd_rows(spark, odd):
    for df in (odd, empty(spark)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, df, SMALL)
            assert out.columns == df.columns
            out.count()
        assert corpus_pipeline.packing(spark, df, SMALL).count() >= df.count()


def test_pipeline_drops_what_stages_find(spark):
    out = corpus_pipeline.run(spark, SMALL)
    assert {"doc_id", "start", "length", "sequence_id", "offset", "ids_crc32"} <= set(out.columns)
    left = {r.doc_id for r in out.select("doc_id").distinct().collect()}
    leaks = QUERIES["op9_decontaminate"](spark, SMALL).select("doc_id").distinct().collect()
    assert 0.5 * 200 < len(left) < 200 and not left & {r.doc_id for r in leaks} - left
