"""Homomorphic fingerprints: sums, edits and successors against a brute-force version."""

import hashlib
import random

import numpy as np
import pytest

from millrace.llm import multiset_hash as mh
from millrace.llm.multiset_hash import Fingerprint, paragraphs


def plain_vector(text):
    """Entries one by one, as Python numbers."""
    words, signs = [0] * 4, [0] * 256
    if text:
        for p in text.replace(". ", ". \n").split("\n"):
            digest = hashlib.sha256(p.encode()).digest()
            for k in range(4):
                words[k] += int.from_bytes(digest[8 * k : 8 * k + 8], "big")
            for j in range(256):
                signs[j] += 1 if digest[j // 8] >> (7 - j % 8) & 1 else -1
    return "".join(f"{w % 2**64:016x}" for w in words) + "".join(f"{s % 2**16:04x}" for s in signs)


def plain_likeness(a, b):
    if a == b:
        return 1.0

    def signed(value):
        return [(int(value[64 + 4 * j : 68 + 4 * j], 16) + 32768) % 65536 - 32768 for j in range(256)]

    x, y = signed(a), signed(b)
    both = sum(v * v for v in x) + sum(v * v for v in y)
    apart = sum(((v - w + 98304) % 65536 - 32768) ** 2 for v, w in zip(x, y, strict=True))
    return max(0.0, 1.0 - apart / both) if both else 0.0


def brute(rows):
    out = []
    for i, (d, text) in enumerate(rows):
        text, following = text or "", rows[(i + 1) % len(rows)][1] or ""
        q = len(text) // 4
        after = text[: len(text) - q] + following[:q]
        own, changed = plain_vector(text), plain_vector(after)
        out.append((d, len(text), hashlib.sha256(after.encode()).hexdigest(), own, changed, plain_likeness(own, changed), plain_likeness(own, plain_vector(following))))
    return out


def random_text(rng, size=12):
    return "".join(rng.choice(["one", "two. ", "Three.", "\n", ". ", ".\n", " ", "é", "\U0001f600", ". \n", "same line.\n"]) for _ in range(rng.randint(0, size)))


def test_sums_are_those_of_the_parts():
    rng = random.Random(1)
    for _ in range(200):
        a, b = (paragraphs(random_text(rng)) for _ in range(2))
        assert Fingerprint.of(a + b) == Fingerprint.of(a) + Fingerprint.of(b) == Fingerprint.of(b + a)
        assert Fingerprint.of(a + b) - Fingerprint.of(b) == Fingerprint.of(a)
        assert Fingerprint.from_hex(Fingerprint.of(a).hex()) == Fingerprint.of(a)


def test_entries_equal_the_plain_sum():
    rng = random.Random(2)
    for text in ["", "\n", "a", "a\na\nb", *(random_text(rng, 40) for _ in range(50)), "\n".join(f"line {i % 5000}" for i in range(9000))]:
        assert Fingerprint.of(paragraphs(text)).hex() == plain_vector(text)


def test_an_edit_exchanges_only_what_it_touches(monkeypatch):
    rng = random.Random(3)
    for _ in range(3000):
        text, following = random_text(rng), random_text(rng)
        after, place = mh.edited(text, following)
        assert mh.fingerprint_after_edit(Fingerprint.of(paragraphs(text)), text, after, place) == Fingerprint.of(paragraphs(after))
    text = "\n".join(f"line {i}" for i in range(1000))
    before = Fingerprint.of(paragraphs(text))
    hashed = []
    plain = Fingerprint.of
    monkeypatch.setattr(Fingerprint, "of", lambda parts: hashed.append(len(parts)) or plain(parts))
    after, place = mh.edited(text, "x" * 5000)
    mh.fingerprint_after_edit(before, text, after, place)
    assert sum(hashed) < 300


def test_likeness_estimates_the_shared_share():
    rng = np.random.default_rng(4)
    for shared in (0, 30, 60, 90, 100):
        common = [f"common {i}" for i in range(shared)]
        estimates = []
        for r in rng.integers(0, 1 << 30, 20).tolist():
            a, b = ([*common, *(f"{side} {r} {i}" for i in range(100 - shared))] for side in "ab")
            estimates.append(Fingerprint.of(a).likeness(Fingerprint.of(b)))
        assert abs(np.mean(estimates) - shared / 100) < 0.06
    assert Fingerprint.of([]).likeness(Fingerprint.of([])) == 1.0 and Fingerprint.of([]).likeness(Fingerprint.of(["a"])) < 0.2


@pytest.mark.parametrize("range_bytes", [1, 40, 10**9])
def test_successors_equal_brute_force(spark, range_bytes):
    rng = random.Random(5)
    rows = [(10 * i, random_text(rng)) for i in range(60)] + [(7, None), (8, ""), (2**60 + 1, "a. b\nc" * 900), (2**60, "x")]
    rows.sort()
    shuffled = rows[:]
    rng.shuffle(shuffled)
    docs = spark.createDataFrame([(*r, "kept") for r in shuffled], "doc_id long, text string, hashed string").repartition(5)
    got = mh.edited_with_next(docs, range_bytes=range_bytes).collect()
    assert sorted(map(tuple, got)) == sorted(brute(rows))


def test_repeated_and_missing_ids(spark):
    rows = [(1, "a. b"), (1, "a. b"), (1, "a. b"), (2, "c"), (None, "d"), (None, None), (None, "d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = mh.edited_with_next(docs, range_bytes=1).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(d) for d, _ in rows)
    equal = [r for r in got if r.doc_id == 1]
    assert sorted(r.near_next == 1.0 for r in equal) == [False, True, True]
    only = mh.edited_with_next(spark.createDataFrame([("b", "some text here")], "doc_id string, text string")).collect()
    assert [(r.doc_id, r.near_next) for r in only] == [("b", 1.0)]
    assert mh.edited_with_next(docs.limit(0)).collect() == []


def test_fingerprints_beside_other_columns(spark):
    docs = spark.createDataFrame([(1, "a\nb", 5), (2, "b\na", 6), (3, None, 7)], "doc_id long, text string, more int")
    got = {r.doc_id: r for r in mh.with_fingerprints(docs).collect()}
    assert got[1].fingerprint == got[2].fingerprint != got[3].fingerprint == "0" * 1088 and got[3].more == 7
