"""Registered queries that SQL cannot express, each whole against a brute-force version."""

import os
import random
import zlib
from collections import defaultdict
from itertools import pairwise

import numpy as np
import pytest
import xxhash

from millrace.llm import packing
from millrace.llm.packing import WordCache, default_tokenizer
from millrace.llm.queries import QUERIES

DATA = os.environ.get("QUERY_SF_DIR", "/root/testdata/sf0.001")
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def texts_of(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}


def plain_fingerprint(text):
    words = text.translate(LOWER).encode().split()
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@needs_data
def test_simhash_query(spark):
    prints = {d: plain_fingerprint(t) for d, t in texts_of(spark).items()}
    root = {d: d for d in prints}
    for a in prints:
        for b in prints:
            if a < b and root[a] != root[b] and (prints[a] ^ prints[b]).bit_count() <= 4:
                old, new = max(root[a], root[b]), min(root[a], root[b])
                root = {d: new if r == old else r for d, r in root.items()}
    got = {tuple(r) for r in QUERIES["op8_simhash_near_dedup"](spark, DATA).collect()}
    assert got == {(d, f"{prints[d]:016x}", root[d]) for d in prints}


@needs_data
def test_packing_query(spark):
    tokenizer = WordCache(default_tokenizer())
    ids = {d: np.frombuffer(tokenizer.direct(t), dtype="<u4").tolist() + [2] for d, t in texts_of(spark).items()}
    pieces, places = defaultdict(list), defaultdict(list)
    for r in QUERIES["op10_best_fit_packing"](spark, DATA).collect():
        pieces[r.doc_id].append((r.piece, r.start, r.length, r.ids_crc32))
        places[r.sequence_id].append((r.offset, r.length))
    assert set(pieces) == set(ids)
    for d, cut in pieces.items():
        cut.sort()
        assert [c[0] for c in cut] == list(range(len(cut)))
        assert cut[0][1] == 0 and all(a[1] + a[2] == b[1] for a, b in pairwise(cut)) and cut[-1][1] + cut[-1][2] == len(ids[d])
        assert len(cut) == -(-len(ids[d]) // 1024)
        for _, start, length, crc in cut:
            assert crc == zlib.crc32(np.array(ids[d][start : start + length], dtype="<u4").tobytes())
    for held in places.values():
        held.sort()
        assert held[0][0] == 0 and all(a[0] + a[1] == b[0] for a, b in pairwise(held)) and held[-1][0] + held[-1][1] <= 1024
    assert len(places) <= 1.02 * -(-sum(map(len, ids.values())) // 1024) + 1


# Space, double space and line feed first, then every white space there is and a zero-width space.
WHITE = [" ", "  ", "\n", *[chr(c) for c in range(0x3001) if chr(c).isspace()], chr(0x200B)]


def test_word_ids_under_every_white_space():
    cache = WordCache(default_tokenizer())
    rng = random.Random(7)
    nbsp = chr(0xA0)
    texts = [" a\tb", "a\tb ", "x\ty  z", f"a{nbsp}b  c", "name\tvalue \nfoo\tbar ", "", " ", "\n", "\n\n", "a\n", "\na", "a \nb", "a\n b"]
    words = ["a", "b1", "it's", "don't.", "x,", "é", "Ünï.", "...", "1,000", "<|endoftext|>", "中文", f"a{nbsp}b"]
    for _ in range(4000):
        texts.append("".join(rng.choice(words) if rng.random() < 0.55 else rng.choice(WHITE if rng.random() < 0.4 else WHITE[:3]) for _ in range(rng.randint(1, 12))))
    for low in range(0, len(texts), 500):
        part = texts[low : low + 500]
        assert cache.encode(part) == [cache.direct(t) for t in part]


def test_equal_rows_are_packed_each_on_its_own(spark):
    docs = spark.createDataFrame([(1, "one two"), (1, "one two"), (None, None), (2, "\t")], "doc_id long, text string")
    got = packing.pack_documents(docs, default_tokenizer()).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in got) == [(False, 1), (False, 1), (False, 2), (True, 0)]
    assert len({(r.sequence_id, r.offset) for r in got}) == 4
