"""Suffix sorting against Python's sort, and removed passages against brute force."""

import hashlib
import os
import random

import numpy as np
import pytest

from millrace.llm import suffix_dedup as sd

DATA = os.environ.get("QUERY_SF_DIR", "/root/testdata/sf0.001")


def test_suffix_order_equals_sorting():
    rng = random.Random(1)
    for _ in range(200):
        symbols = np.array([rng.randrange(1, rng.choice([2, 3, 5, 30]) + 1) for _ in range(rng.randrange(1, 200))])
        symbols = np.tile(symbols, 4) if rng.random() < 0.3 else symbols
        reach = rng.choice([1, 5, 50, 1000])
        order = sd.suffix_order(symbols, reach).tolist()
        assert sorted(order) == list(range(len(symbols)))
        prefixes = [tuple(symbols[i : i + reach].tolist()) for i in order]
        assert prefixes == sorted(prefixes)


def test_equal_windows_have_equal_classes():
    rng = random.Random(2)
    for _ in range(60):
        data = bytes(rng.choice(b"ab") for _ in range(rng.randrange(60, 300))) * rng.choice([1, 3])
        starts = np.array(sorted(rng.sample(range(len(data) - 49), min(len(data) - 49, 40))))
        classes = sd.equal_windows(data, starts)
        texts = [data[a : a + 50] for a in starts.tolist()]
        assert all((classes[i] == classes[j]) == (texts[i] == texts[j]) for i in range(len(texts)) for j in range(len(texts)))


def brute(rows):
    least = {}
    for owner, text in rows:
        body = (text or "").encode()
        for i in range(len(body) - 49):
            if owner is not None:
                least[body[i : i + 50]] = min(owner, least.get(body[i : i + 50], owner))
    out = []
    for owner, text in rows:
        body = (text or "").encode()
        gone = set()
        for i in range(len(body) - 49):
            if owner is not None and least[body[i : i + 50]] < owner:
                gone.update(range(i, i + 50))
        kept = bytes(b for i, b in enumerate(body) if i not in gone)
        out.append((owner, len(body), len(gone), sum(i - 1 not in gone for i in gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def report(docs, **sizes):
    from pyspark.sql import functions as F

    found = sd.find_repeats(docs, **sizes)
    return sorted(
        ((r.doc_id, r.n_bytes, sum(s.end - s.start for s in r.removed), len(r.removed), r.kept_sha256) for r in found.select("doc_id", "n_bytes", "removed", F.col("kept_sha256")).collect()), key=str
    )


def made_up():
    rng = random.Random(3)
    letters = "abcdé "
    passages = ["".join(rng.choice(letters) for _ in range(n)) for n in (49, 50, 51, 80, 200, 1000)]
    rows = [(None, passages[4]), (1, None), (2, ""), (3, passages[5]), (3, passages[5]), (4, passages[5]), (5, "x" * 300), (6, "x" * 120)]
    for i in range(7, 120):
        parts = [rng.choice(passages + ["".join(rng.choice(letters) for _ in range(rng.randrange(60)))]) for _ in range(rng.randrange(6))]
        rows.append((i, "".join(parts)))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("sizes", [{}, {"block_bytes": 3000, "part_bytes": 4000, "sort_bytes": 1500, "spread_blocks": 3}, {"block_bytes": 2000, "part_bytes": 9000, "spread_blocks": 1, "chunk": 100}])
def test_made_up_documents_equal_brute_force(spark, sizes):
    rows = made_up()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert report(docs, **sizes) == brute(rows)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id string, text string, block int")
    assert report(docs) == []


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_query_equals_brute_force(spark):
    from millrace.llm.queries import QUERIES

    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    got = [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in QUERIES["op7_repeated_passages"](spark, DATA).collect()]
    assert sorted(got, key=str) == brute(rows)


def test_only_different_texts_of_an_anchor_travel_as_bytes():
    """A passage in very many blocks is settled by digests; of different texts around one anchor, each is asked for once."""
    rng = random.Random(5)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(400))
    blocks = []
    for k in range(100):
        before, after = ("".join(rng.choice("abcdefgh ") for _ in range(60)) for _ in range(2))
        blocks.append(sd.Block([2 * k, 2 * k + 1], [before + passage + after, passage], sd.WINDOW, sd.GRAM))
    found = [sd.Stretches(b, {0: np.ones(len(b.anchors()[0]), np.uint8).tobytes()}, 1) for b in blocks]
    judged = sd.judge(np.concatenate([f.anchor for f in found]), np.concatenate([f.digest for f in found]), [o for f in found for o in f.owner], 1000)
    judged = np.split(judged, np.cumsum([len(f.anchor) for f in found])[:-1])
    # All stretches inside the passage are alike, and the smallest id is that of the first block.
    inside = [set(f.anchor[j == sd.REPEATED].tolist()) for f, j in zip(found, judged, strict=True)]
    assert not inside[0] and min(len(i) for i in inside[1:]) > 10
    asked = [sum(sd.Stretches.asked(f, j, 1)[2].tolist()) for f, j in zip(found, judged, strict=True)]
    assert sum(asked) < 100 * 150 < 100 * len(passage)


def test_stretches_of_equal_bytes_have_equal_digests():
    rng = random.Random(6)
    text = "".join(rng.choice("ab") for _ in range(700))
    block = sd.Block([1, 2], [text, "b" * 61 + text], sd.WINDOW, sd.GRAM, chunk=100)
    digests = block.digests(block.first, block.count).tolist()
    bodies = [block.data[a : a + n + 49] for a, n in zip(block.first.tolist(), block.count.tolist(), strict=True)]
    assert len(set(bodies)) == len(set(digests)) == len(set(zip(bodies, digests, strict=True))) < len(bodies)


def test_anchors_are_dealt_evenly():
    """Smallest hashes crowd near zero; no partition may get many times the anchors or bytes of another."""
    rng = random.Random(7)
    block = sd.Block([1], ["".join(rng.choice("abcdefgh ") for _ in range(300_000))], sd.WINDOW, sd.GRAM)
    values, _ = block.anchors()
    part = sd._parts(values, 40)
    found = sd.Stretches(block, {p: np.ones((part == p).sum(), np.uint8).tobytes() for p in set(part.tolist())}, 40)
    asked = found.asked(np.full(len(found.anchor), sd.WHOLE, np.uint8), 40)
    for where in (part, found.part, asked[0]):
        dealt = np.bincount(where.astype(np.int64), minlength=40)
        assert dealt.max() < 2 * dealt.mean() and dealt.min() > dealt.mean() / 2
