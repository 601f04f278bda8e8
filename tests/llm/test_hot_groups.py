"""Groups that a third of the rows share: repeats, their marks, and rows without an id."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa

from starloom.llm import ngram_join, suffix_dedup


def test_united_marks_cover_the_same_bytes():
    draw = random.Random(1)
    for _ in range(200):
        marks = [(draw.randrange(-3, 3), a := draw.randrange(300), a + draw.randrange(1, 40)) for _ in range(draw.randrange(1, 40))]
        united = suffix_dedup._united(np.array(marks, suffix_dedup._MARK))
        cover = lambda rows: {(int(d), p) for d, a, b in rows for p in range(a, b)}
        assert cover(united.tolist()) == cover(marks)
        spans = sorted(united.tolist())
        assert all(a[0] != b[0] or a[2] < b[1] for a, b in zip(spans, spans[1:], strict=False))


def test_marks_of_a_passage_in_all_slices_do_not_share_a_bucket():
    draw = random.Random(7)
    passage = "".join(draw.choices("abcdefghij ", k=400))
    sizes = Counter()
    for n in range(60):
        texts = ["".join(draw.choices("klmnop ", k=100)) + passage for _ in range(4)]
        ids = pa.array([4 * n + i for i in range(4)], pa.int64())
        keys = pa.array([draw.getrandbits(62) for _ in texts], pa.int64())
        batch = pa.RecordBatch.from_arrays([ids, keys, pa.array(texts)], ["doc_id", "doc", "text"])
        for out in suffix_dedup._deal(16, 50, 20)(iter([batch])):
            for bucket, marks in zip(out.column("bucket").to_pylist(), out.column("marks").to_pylist(), strict=True):
                sizes[bucket] += len(marks)
    assert sum(sizes.values()) >= 60 * 3 * suffix_dedup._MARK.itemsize
    assert len([b for b, n in sizes.items() if n]) >= 12 and max(sizes.values()) < 0.2 * sum(sizes.values())


def test_trie_follows_the_global_order():
    rank = np.random.default_rng(3).permutation(1 << ngram_join.ORDER_BITS).astype(np.uint64)
    grams = np.random.default_rng(4).integers(0, 1 << 63, 40, dtype=np.uint64) * np.uint64(2)
    sets = [ngram_join.ordered(grams[i : i + 20], rank) for i in range(0, 20, 2)]
    tree = ngram_join.PrefixTree(sets)
    names = np.unique(np.concatenate(sets))[::-1]  # place 0 is the most frequent one
    for i, path in zip(tree.order, tree.paths, strict=True):
        assert sorted(names[path].tolist()) == sorted(sets[i].tolist())
        assert (names[path][:-1] > names[path][1:]).all()
    assert Counter(len(p) for p in tree.paths) == {20: 10}


def test_join_where_a_third_of_the_rows_have_no_id(spark):
    draw = random.Random(12)
    base = [f"w{draw.randrange(400)}" for _ in range(120)]
    rows = []
    for n in range(90):
        words = list(base) if n % 2 else [f"x{draw.randrange(10_000)}" for _ in range(60)]
        words[n % 50] = f"new{n}"
        rows.append((None if n % 3 == 0 else n, " ".join(words)))
    rows += [(None, " ".join(base))] * 60 + [(7, rows[7][1])] * 30
    found = ngram_join.ngram_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(found) == len(rows)
    near = [n for n in range(90) if n % 2 and n % 3]
    for r in found:
        if r.doc_id in near or r.n_shingles == len({tuple(base[i : i + 5]) for i in range(116)}):
            assert r.component_id == min(near)
        elif r.doc_id is not None:
            assert r.component_id == r.doc_id
    kept = ngram_join.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sum(r.doc_id in near for r in kept) == 1 and len(kept) == 1 + 45
