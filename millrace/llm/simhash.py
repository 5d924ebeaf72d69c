"""SimHash near-duplicates through a byte-position index with count filtering.

A fingerprint has eight bytes at fixed positions. Two fingerprints at most
``BITS`` bits apart differ in at most ``BITS`` bytes, so they share at least
``8 - BITS`` positional bytes: the guaranteed minimum. Posting lists of single
positional bytes would hold a 256th of all fingerprints each, and tallying
pairs from them grows with the square of the corpus. The index is therefore
keyed by the minimum itself: one posting list for each choice of that many
positions and their bytes, so that a pair meets in a list exactly if its tally
reaches the minimum. Pairs that meet are verified on their bits.

Equal fingerprints are one entry. A posting list yields at most one link less
than it has entries (a spanning forest of its verified pairs, found without
writing pairs down); long lists are cut into blocks and every two blocks meet
in one task, so no list has to fit one task.

Defined results: null and empty texts and texts without words have fingerprint
0 and are linked like any other; equal rows have equal fingerprints; null ids
are kept (a component's id is the smallest id that is not null); an empty table
gives an empty table; only the named columns are read, others are carried
through by ``keep_one``.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.components import connected_components
from millrace.llm.text import add_columns, fresh_name, spaced_words
from millrace.session import settle

SHINGLE_WORDS = 4
SEED = 42
BITS = 4
# Entries of a posting list that are compared with each other in one task.
BLOCK = 8192
_BIT_ROWS = 1 << 16


def fingerprint(words: list[bytes], shingle: int = SHINGLE_WORDS) -> int:
    """64 bits: each 1 if set in over half of the shingles' hashes; 0 without words."""
    n = len(words)
    if not n:
        return 0
    joined = b" ".join(words)
    if n <= shingle:
        return xxhash.xxh64_intdigest(joined, SEED)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=n)
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    digest = xxhash.xxh64_intdigest
    hashes = np.array(
        [digest(joined[a:b], SEED) for a, b in zip(starts[: n - shingle + 1].tolist(), ends[shingle - 1 :].tolist(), strict=True)], dtype="<u8"
    )
    counts = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), _BIT_ROWS):
        part = hashes[i : i + _BIT_ROWS]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    set_bits = np.flatnonzero(2 * counts > len(hashes)).tolist()
    return sum(1 << b for b in set_bits)


def _signed(value: int) -> int:
    return value - (1 << 64) if value >= 1 << 63 else value


def with_fingerprints(docs: DataFrame, text: str, name: str, shingle: int = SHINGLE_WORDS) -> DataFrame:
    """Add the fingerprint as a signed 64-bit number."""

    def make():
        return lambda texts: [[_signed(fingerprint(spaced_words(t), shingle)) for t in texts]]

    return add_columns(docs, [text], T.StructType([T.StructField(name, T.LongType())]), make)


def _byte_choices(bits: int) -> list[int]:
    """Masks over every choice of the guaranteed number of shared positional bytes."""
    return [_signed(sum(0xFF << (8 * p) for p in chosen)) for chosen in combinations(range(8), 8 - bits)]


def forest(entries: np.ndarray, bits: int) -> list[tuple[int, int]]:
    """A spanning forest of the pairs at most ``bits`` apart."""
    links = []
    left = entries
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            seed = queue.pop()
            near = np.bitwise_count((left ^ seed).view(np.uint64)) <= bits
            if near.any():
                found = left[near]
                links.extend((int(seed), int(x)) for x in found)
                queue.extend(found)
                left = left[~near]
    return links


def _linked(bits: int):
    """Links within runs of equal keys of sorted rows (list, bytes, block, entry)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_keys = np.zeros((0, 3), dtype=np.int64)
        held = np.zeros(0, dtype=np.int64)

        def links_of(keys: np.ndarray, entries: np.ndarray) -> pa.RecordBatch | None:
            cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
            bounds = np.concatenate(([0], cuts, [len(keys)]))
            out: list[tuple[int, int]] = []
            for g in np.flatnonzero(np.diff(bounds) > 1).tolist():
                out += forest(entries[bounds[g] : bounds[g + 1]], bits)
            if not out:
                return None
            one, other = zip(*out, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(one, pa.int64()), pa.array(other, pa.int64())], names=["one", "other"])

        for batch in batches:
            columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)]
            held_keys = np.concatenate([held_keys, np.stack(columns[:3], axis=1)])
            held = np.concatenate([held, columns[3]])
            # The last key may go on in the next batch.
            open_from = int(np.flatnonzero((held_keys != held_keys[-1]).any(axis=1))[-1]) + 1 if (held_keys != held_keys[-1]).any() else 0
            if open_from and (found := links_of(held_keys[:open_from], held[:open_from])):
                yield found
            held_keys, held = held_keys[open_from:], held[open_from:]
        if len(held) > 1 and (found := links_of(held_keys, held)):
            yield found

    return run


def fingerprint_links(entries: DataFrame, name: str, bits: int = BITS, block: int = BLOCK) -> DataFrame:
    """Links (one, other) that connect distinct fingerprints exactly as all pairs at most ``bits`` apart would."""
    masks = _byte_choices(bits)
    postings = entries.select(
        F.col(name).alias("entry"), F.posexplode(F.array(*[F.col(name).bitwiseAND(F.lit(m)) for m in masks])).alias("list", "bytes")
    ).withColumn("list", F.col("list").cast("long"))
    long_lists = settle(postings.groupBy("list", "bytes").count().where(F.col("count") > block), "long-postings")
    blocks = F.ceil(F.col("count") / F.lit(block)).cast("long")
    own = F.pmod(F.xxhash64("entry"), blocks)
    # Block pair (a, b), a <= b, as one number; an entry meets every block of its list.
    met = F.explode(F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda b: F.least(b, F.col("own")) * F.col("blocks") + F.greatest(b, F.col("own"))))
    cut = (
        postings.join(long_lists, ["list", "bytes"], "left")
        .select("list", "bytes", "entry", F.coalesce(blocks, F.lit(1).cast("long")).alias("blocks"), F.coalesce(own, F.lit(0).cast("long")).alias("own"))
        .select("list", "bytes", met.alias("block"), "entry")
    )
    dealt = cut.repartition("list", "bytes", "block").sortWithinPartitions("list", "bytes", "block", "entry")
    return dealt.mapInArrow(_linked(bits), "one long, other long")


def near_duplicate_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE_WORDS, bits: int = BITS) -> DataFrame:
    """Rows (doc_id, fingerprint, component_id), the fingerprint as a signed number."""
    prints = settle(with_fingerprints(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), "text", "fingerprint", shingle).drop("text"), "fingerprints")
    entries = settle(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("first_id")), "fingerprint-entries")
    roots = connected_components(fingerprint_links(entries, "fingerprint", bits), "one", "other")
    joined = roots.join(entries, roots["node"] == entries["fingerprint"]).select("node", "root", "first_id")
    least = joined.groupBy("root").agg(F.min("first_id").alias("component_id"))
    linked = joined.join(least, "root").select(F.col("node").alias("fingerprint"), "component_id")
    named = entries.join(linked, "fingerprint", "left").select("fingerprint", F.coalesce("component_id", "first_id").alias("component_id"))
    return prints.join(named, "fingerprint").select("doc_id", "fingerprint", "component_id")


def hexadecimal(fingerprint_column: Column) -> Column:
    return F.lower(F.lpad(F.hex(fingerprint_column), 16, "0"))


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE_WORDS, bits: int = BITS) -> DataFrame:
    """The document with the smallest id of each group, unchanged.

    Rows without an id stay, and of equal ids all rows stay.
    """
    groups = near_duplicate_groups(docs, doc_id, text, shingle, bits)
    key = fresh_name(docs.schema, "leaves")
    leaving = groups.where(F.col("doc_id") != F.col("component_id")).select(F.col("doc_id").alias(key)).distinct()
    return docs.join(leaving, docs[doc_id] == leaving[key], "left_anti")
