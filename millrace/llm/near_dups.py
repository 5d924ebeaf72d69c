"""Near-duplicates by the Jaccard similarity of whole sets of five-word shingles.

Candidates come from MinHash: ``BANDS`` keys of ``ROWS`` minima each. A pair of
similarity s shares a key with probability 1 - (1 - s^ROWS)^BANDS, 0.99993 at
0.8. Candidates are verified on their whole shingle sets, so no pair below
``SHARE`` is linked.

Equal sets are one entry. The entries of a key are tied to its smallest one,
which gives loose groups with one link for each posting instead of pairs. The
texts of a loose group travel once to one task, where a spanning forest of the
verified pairs is found; large groups are cut into blocks of which every two
meet in one task, so no group has to fit one task.

Defined results: null texts and texts without words are equal to each other,
texts of fewer words than a shingle are one shingle; null ids are kept (a
component's id is the smallest id that is not null); an empty table gives an
empty table; only the named columns are read, others are carried through by
``keep_one``. Shingles and sets are told apart by 64-bit hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.components import connected_components
from millrace.llm.text import add_columns, fresh_name, spaced_words
from millrace.session import settle

SHINGLE_WORDS = 5
# The least similarity, as a fraction.
SHARE = (4, 5)
BANDS, ROWS = 24, 5
SEED = 42
# Entries and bytes of text of a loose group that make one block.
BLOCK = 4096
BLOCK_BYTES = 16_000_000
_AT_ONCE = 1 << 14

_rng = np.random.default_rng(SEED)
_FACTORS = _rng.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32) | np.uint32(1)
_FLIPS = _rng.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32)


def shingle_set(text: str | None) -> np.ndarray:
    """The distinct hashes of a text's shingles, ascending."""
    words = spaced_words(text)
    n = len(words)
    if not n:
        return np.zeros(0, dtype=np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=n) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    size = min(n, SHINGLE_WORDS)
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(joined[a:b], SEED) for a, b in zip(starts[: n - size + 1].tolist(), ends[size - 1 :].tolist(), strict=True)], dtype=np.uint64))


def band_keys(shingles: np.ndarray) -> list[int]:
    """One signed key for each band; none for an empty set."""
    if not len(shingles):
        return []
    least = np.full(BANDS * ROWS, 0xFFFFFFFF, dtype=np.uint32)
    low = (shingles >> np.uint64(32)).astype(np.uint32)
    for i in range(0, len(low), _AT_ONCE):
        values = low[None, i : i + _AT_ONCE] ^ _FLIPS[:, None]
        values *= _FACTORS[:, None]
        # Odd factors leave low bits poor; the high half is folded in.
        values ^= values >> np.uint32(15)
        values *= np.uint32(0x2C1B3C6D)
        least = np.minimum(least, values.min(axis=1))
    data = least.tobytes()
    return [_signed(xxhash.xxh64_intdigest(data[4 * ROWS * b : 4 * ROWS * (b + 1)], b)) for b in range(BANDS)]


def _signed(value: int) -> int:
    return value - (1 << 64) if value >= 1 << 63 else value


def _with_keys(docs: DataFrame) -> DataFrame:
    """Add the hash of a text's shingle set and its band keys."""

    def make():
        def keys(texts: list) -> list[list]:
            sets = [shingle_set(t) for t in texts]
            return [[_signed(xxhash.xxh64_intdigest(s.tobytes(), SEED)) for s in sets], [band_keys(s) for s in sets]]

        return keys

    return add_columns(docs, ["text"], T.StructType([T.StructField("entry", T.LongType()), T.StructField("bands", T.ArrayType(T.LongType()))]), make)


def forest(sets: list[np.ndarray], bands: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the pairs that share a band key and are similar enough, as places."""
    more, less = SHARE[1], SHARE[0]
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    distinct, number = np.unique(np.concatenate(sets), return_inverse=True)
    numbers = np.split(number, np.cumsum(sizes)[:-1])
    held = np.zeros(len(distinct), dtype=bool)
    links = []
    left = np.arange(len(sets))
    while len(left) > 1:
        queue, left = [int(left[0])], left[1:]
        while queue and len(left):
            seed = queue.pop()
            meets = (bands[left] == bands[seed]).any(axis=1)
            meets &= more * np.minimum(sizes[left], sizes[seed]) >= less * np.maximum(sizes[left], sizes[seed])
            places = np.flatnonzero(meets)
            if not len(places):
                continue
            held[numbers[seed]] = True
            shared = np.array([np.count_nonzero(held[numbers[c]]) for c in left[places].tolist()], dtype=np.int64)
            held[numbers[seed]] = False
            places = places[more * shared >= less * (sizes[left[places]] + sizes[seed] - shared)]
            found = left[places].tolist()
            links.extend((seed, c) for c in found)
            queue.extend(found)
            left = np.delete(left, places)
    return links


def verified_links(entries: DataFrame, texts: DataFrame, block: int = BLOCK, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Links (one, other) that connect entries exactly as all candidate pairs of enough similarity would.

    ``entries`` has (entry, bands), ``texts`` has (entry, text), one text or more for each entry.
    """
    postings = entries.select("entry", F.explode("bands").alias("key"))
    met = postings.groupBy("key").agg(F.min("entry").alias("low"), F.count(F.lit(1)).alias("n")).where(F.col("n") > 1).drop("n")
    ties = postings.join(met, "key").where(F.col("entry") != F.col("low")).select("entry", "low")
    loose = settle(connected_components(ties, "entry", "low").select(F.col("node").alias("entry"), "root"), "loose-groups")
    # Texts of an entry have the same shingles; any one serves.
    members = settle(texts.join(loose, "entry").groupBy("entry", "root").agg(F.first("text").alias("text")).join(entries.select("entry", "bands"), "entry"), "loose-texts")
    blocks = F.greatest(F.ceil(F.count(F.lit(1)) / F.lit(block)), F.ceil(F.sum(F.octet_length("text")) / F.lit(block_bytes))).cast("long")
    counted = members.groupBy("root").agg(blocks.alias("blocks"))
    own = F.pmod(F.xxhash64("entry"), F.col("blocks"))
    # Block pair (a, b), a <= b, as one number; an entry meets every block of its group.
    pair = F.explode(F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda b: F.least(b, F.col("own")) * F.col("blocks") + F.greatest(b, F.col("own"))))
    dealt = members.join(counted, "root").withColumn("own", own).select("root", pair.alias("block"), "entry", "bands", "text")

    def link(table: pa.Table) -> pa.Table:
        entry = table.column("entry").to_numpy()
        found = forest([shingle_set(t) for t in table.column("text").to_pylist()], np.array(table.column("bands").to_pylist(), dtype=np.int64))
        one, other = entry[[a for a, _ in found]], entry[[b for _, b in found]]
        return pa.table({"one": pa.array(one, pa.int64()), "other": pa.array(other, pa.int64())})

    return dealt.groupBy("root", "block").applyInArrow(link, "one long, other long")


def near_duplicate_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", block: int = BLOCK, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Rows (doc_id, component_id)."""
    keyed = settle(_with_keys(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))), "shingle-keys")
    entries = settle(keyed.groupBy("entry").agg(F.min("doc_id").alias("first_id"), F.first("bands").alias("bands")), "shingle-entries")
    roots = connected_components(verified_links(entries, keyed.select("entry", "text"), block, block_bytes), "one", "other")
    joined = roots.join(entries.select("entry", "first_id"), roots["node"] == F.col("entry")).select("node", "root", "first_id")
    least = joined.groupBy("root").agg(F.min("first_id").alias("component_id"))
    linked = joined.join(least, "root").select(F.col("node").alias("entry"), "component_id")
    named = entries.select("entry", "first_id").join(linked, "entry", "left").select("entry", F.coalesce("component_id", "first_id").alias("component_id"))
    return keyed.select("doc_id", "entry").join(named, "entry").select("doc_id", "component_id")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The document with the smallest id of each group, unchanged.

    Rows without an id stay, and of equal ids all rows stay.
    """
    groups = near_duplicate_groups(docs, doc_id, text)
    key = fresh_name(docs.schema, "leaves")
    leaving = groups.where(F.col("doc_id") != F.col("component_id")).select(F.col("doc_id").alias(key)).distinct()
    return docs.join(leaving, docs[doc_id] == leaving[key], "left_anti")
