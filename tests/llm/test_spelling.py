"""Spelling variants against brute force over all pairs of words."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from millrace.llm import spelling

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def one_apart(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    if abs(len(a) - len(b)) != 1:
        return False
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_groups(counts):
    near = {w: [v for v in counts if one_apart(w, v)] for w in counts}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= 2 * counts[w] else None
    out = set()
    for w in counts:
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, counts[w], len(near[w]), counts[form[w]] if form[w] else None))
    return out


def brute_counts(docs):
    counts = Counter()
    for d, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            counts[run if h % 97 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    return {w: n for w, n in counts.items() if n >= 3 and len(w) >= 5}


def random_word(rng, letters="abé"):
    return "".join(rng.choice(letters) for _ in range(rng.randint(5, 8)))


@pytest.mark.parametrize("range_words", [1, 7, 100_000])
def test_groups_equal_all_pairs(spark, range_words):
    rng = random.Random(range_words)
    counts = {random_word(rng): rng.choice([3, 4, 6, 8, 16, 40, 90]) for _ in range(150)}
    counts |= {"aaaaa": 7, "aaaaaa": 14, "aaaaaaa": 28, "aaaaaaaa": 60, "aaaaa" * 400: 3, "aaaaa" * 400 + "b": 9, "lonely": 3, "ÿÿÿÿÿ": 5, "ÿÿÿÿÀ": 5}
    table = spark.createDataFrame(list(counts.items()), "word string, n long")
    got = [tuple(r) for r in spelling.spelling_groups(table, range_words=range_words).collect()]
    assert len(got) == len(counts) and set(got) == brute_groups(counts)


def test_texts_equal_brute_force(spark):
    rng = random.Random(11)
    vocabulary = [random_word(rng, "abcdeÀé") for _ in range(60)]
    docs = [(i, " ".join(rng.choice(vocabulary).capitalize() if rng.random() < 0.3 else rng.choice(vocabulary) for _ in range(rng.randint(0, 300)))) for i in range(80)]
    docs += [(3, docs[3][1]), (None, docs[4][1]), (99, None), (98, ""), (97, "÷×÷×÷ ÷×÷×÷ ÷×÷×÷ 12345 ab-cd")]
    counts = brute_counts(docs)
    table = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, n int")
    assert {r.word: r.n for r in spelling.word_counts(table).collect()} == counts
    assert {tuple(r) for r in spelling.variant_report(table).collect()} == brute_groups(counts)
    assert len(counts) > 60


def test_words_are_counted_in_parts(spark, monkeypatch):
    docs = [(i, "alpha beta gamma delta " * 3) for i in range(20)]
    monkeypatch.setattr(spelling, "COUNTED_TOGETHER", 2)
    whole = Counter()
    for d in docs:
        whole += spelling.document_words(*d, 5, 97)
    got = spelling.word_counts(spark.createDataFrame(docs, "doc_id long, text string"), occurrences=1).collect()
    assert {r.word: r.n for r in got} == whole


def test_nodes_are_the_same_for_any_ranges(spark):
    rng = random.Random(2)
    words = sorted({random_word(rng, "ab") for _ in range(200)})
    table = spark.createDataFrame([(w,) for w in words], "word string")
    for range_words in (3, 50, 1000):
        nodes = {r.word: r.nodes for r in spelling.with_nodes(table, "word", "nodes", range_words).collect()}
        prefixes = {}
        for w in words:
            assert len(nodes[w]) == len(w) + 1
            for k in range(len(w) + 1):
                assert prefixes.setdefault(w[:k], nodes[w][k]) == nodes[w][k]
        assert len(set(prefixes.values())) == len(prefixes)
        assert [nodes[w][-1] for w in words] == sorted(nodes[w][-1] for w in words)


def test_pairs_split_over_batches():
    import pyarrow as pa

    rows = np.array([(1, 1, 1, 9, 5), (1, 1, 1, 9, 7), (1, 1, 2, 4, 3), (2, 1, 1, 3, 5), (2, 1, 0, 2, 9), (2, 1, 2, 1, 4), (3, 3, 1, 1, 1)], dtype=np.int64)
    want = [(5, 2, 9, 7), (7, 2, 9, 5), (3, 2, 9, 5), (5, 2, 2, 9), (9, 1, 3, 5), (4, 1, 3, 5)]
    for size in (1, 2, 7):
        batches = [pa.RecordBatch.from_arrays([pa.array(c) for c in rows[i : i + size].T], names=list("abcde")) for i in range(0, len(rows), size)]
        got = [tuple(r.values()) for b in spelling._neighbours(iter(batches)) for r in b.to_pylist()]
        assert got == want


def test_an_empty_table_gives_an_empty_table(spark):
    assert spelling.variant_report(spark.createDataFrame([], "doc_id long, text string")).collect() == []
