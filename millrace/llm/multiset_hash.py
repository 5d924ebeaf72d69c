"""Homomorphic fingerprints of documents: sums of vectors hashed from paragraphs.

A paragraph is hashed to 256 bits and these to a wide vector: four 64-bit
entries, and one entry of 1 or -1 for each bit. A document's fingerprint is the
sum over its paragraphs, with repeats, the first entries modulo 2^64 and the
others modulo 2^16. So

* the order of paragraphs does not matter, and equal multisets of paragraphs
  have equal fingerprints;
* a paragraph is inserted by adding its vector and deleted by subtracting it,
  and fingerprints of parts add up to that of the whole;
* the difference of two fingerprints is the fingerprint of the paragraphs that
  they do not share. The mean square of its 1/-1 part estimates how many those
  are (the sum of squared differences in count), and likeness is one less that
  over the sum of both documents' own: 1 for equal multisets, around 0 for
  disjoint ones, with a standard error below 1/16.

A paragraph ends after a line feed, or after a full stop with a space: a rule
that looks only backwards, so an edit changes the paragraphs it touches and no
other. An empty text has none.

Documents meet their successors in ``edited_with_next`` by ranges of ids: the
places where ranges begin come from ids alone, rows are shuffled once, and the
first row of a range goes to the range before it too.

Defined results: a null text is an empty one, with a fingerprint of zeros and
likeness 1 to another empty one and 0 to any other; rows of equal id follow in
the order of their texts' hashes, and rows equal in both share one range, where
they follow each other and are read one by one; null ids come last; an only document is its own successor; an empty table gives an empty
table. Likeness of documents that hold a paragraph over 32,767 times is
measured on counts modulo 2^16.
"""

from __future__ import annotations

import hashlib
import math
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from millrace.llm.text import ROWS_AT_ONCE, add_columns

WORDS, SIGNS = 4, 256
# Bytes of text of a range of ids, and ranges at most (beyond, ranges hold more).
RANGE_BYTES = 4_000_000
MOST_RANGES = 100_000
# Paragraphs of a document whose bits are spread out together.
_AT_ONCE = 4096


def paragraphs(text: str | None) -> list[str]:
    """A text in paragraphs: the mark that ends one is told by what stands at its end."""
    return text.replace(". ", ". \n").split("\n") if text else []


class Fingerprint:
    """A sum of paragraph vectors; immutable."""

    __slots__ = ("signs", "words")

    def __init__(self, words: np.ndarray, signs: np.ndarray):
        self.words, self.signs = words, signs

    @classmethod
    def of(cls, parts: list[str]) -> Fingerprint:
        if not parts:
            return cls(np.zeros(WORDS, np.uint64), np.zeros(SIGNS, np.uint16))
        counts = Counter(parts)
        digest = hashlib.sha256
        hashed = np.frombuffer(b"".join([digest(p.encode()).digest() for p in counts]), dtype=np.uint8).reshape(-1, 32)
        copies = np.fromiter(counts.values(), dtype=np.uint64, count=len(counts))
        words = (hashed.view(">u8").astype(np.uint64) * copies[:, None]).sum(axis=0, dtype=np.uint64)
        ones = np.zeros(SIGNS, np.int64)
        for low in range(0, len(copies), _AT_ONCE):
            bits = np.unpackbits(hashed[low : low + _AT_ONCE], axis=1)
            ones += (copies[low : low + _AT_ONCE, None].astype(np.int64) * bits).sum(axis=0)
        return cls(words, (2 * ones - len(parts)).astype(np.uint16))

    def __add__(self, other: Fingerprint) -> Fingerprint:
        return Fingerprint(self.words + other.words, self.signs + other.signs)

    def __sub__(self, other: Fingerprint) -> Fingerprint:
        return Fingerprint(self.words - other.words, self.signs - other.signs)

    def __eq__(self, other: object) -> bool:
        return isinstance(other, Fingerprint) and bool((self.words == other.words).all() and (self.signs == other.signs).all())

    __hash__ = None

    def hex(self) -> str:
        return self.words.astype(">u8").tobytes().hex() + self.signs.astype(">u2").tobytes().hex()

    @classmethod
    def from_hex(cls, value: str) -> Fingerprint:
        data = bytes.fromhex(value)
        return cls(np.frombuffer(data[: 8 * WORDS], ">u8").astype(np.uint64), np.frombuffer(data[8 * WORDS :], ">u2").astype(np.uint16))

    def energy(self) -> int:
        """The sum of squares of the 1/-1 part, with signs."""
        signed = self.signs.view(np.int16).astype(np.int64)
        return int(signed @ signed)

    def likeness(self, other: Fingerprint) -> float:
        """1 for equal multisets; else the estimated share of paragraphs in common, 0 at least."""
        both = self.energy() + other.energy()
        if self == other:
            return 1.0
        return max(0.0, 1.0 - (self - other).energy() / both) if both else 0.0


def edited(text: str, following: str) -> tuple[str, int]:
    """The text with its last quarter replaced by the following one's first code points, and the place of the change."""
    quarter = len(text) // 4
    return text[: len(text) - quarter] + following[:quarter], len(text) - quarter


def fingerprint_after_edit(before: Fingerprint, text: str, after: str, place: int) -> Fingerprint:
    """The fingerprint of ``after``, which equals ``text`` up to ``place``: paragraphs from there are exchanged."""
    if place == 0:
        return Fingerprint.of(paragraphs(after))
    sentence = text.rfind(". ", 0, place)
    start = max(text.rfind("\n", 0, place) + 1, sentence + 2 if sentence >= 0 else 0)
    return before - Fingerprint.of(paragraphs_from(text, start)) + Fingerprint.of(paragraphs_from(after, start))


def paragraphs_from(text: str, start: int) -> list[str]:
    """The paragraphs of a text that stand from ``start``, the beginning of one."""
    return paragraphs(text[start:]) if start < len(text) else [""]


def with_fingerprints(docs: DataFrame, text: str = "text", name: str = "fingerprint") -> DataFrame:
    """Add the fingerprint as a hexadecimal string."""

    def make():
        return lambda texts: [[Fingerprint.of(paragraphs(t)).hex() for t in texts]]

    return add_columns(docs, [text], T.StructType([T.StructField(name, T.StringType())]), make)


def range_starts(keys: DataFrame, total_bytes: int, range_bytes: int) -> list[tuple]:
    """The keys (is null, id, hash) at which ranges of some ``range_bytes`` begin, ascending; at most ``MOST_RANGES``."""
    wanted = min(MOST_RANGES, math.ceil(total_bytes / range_bytes) or 1)
    ranged = keys.select(F.struct(F.col("doc_id").isNull().alias("missing"), "doc_id", "hashed").alias("key")).repartitionByRange(wanted, "key")
    # One row for each range, which bounds what comes here.
    firsts = ranged.groupBy(F.spark_partition_id().alias("range")).agg(F.min("key").alias("first")).collect()
    return sorted(_key(r.first.doc_id, r.first.hashed) for r in firsts)


def _key(doc_id, hashed: int) -> tuple:
    """Ascending ids, missing ones last."""
    missing = doc_id is None
    return missing, 0 if missing else doc_id, hashed


def edited_with_next(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Rows (doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next).

    The edited text has its last quarter of code points replaced by as many of
    the next document, in ascending order of ids; the first follows the last.
    """
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(F.col(doc_id).alias("doc_id"), body.alias("text"), F.xxhash64(body).alias("hashed"))
    size = rows.agg(F.sum(F.octet_length("text")).alias("bytes")).first().bytes or 0
    starts = docs.sparkSession.sparkContext.broadcast(range_starts(rows, size, range_bytes))

    @F.arrow_udf("array<int>")
    def ranges_of(ids: pa.Array, hashed: pa.Array) -> pa.Array:
        """The range of a row; for a row that begins one, also -1 less the range before, where it is a guest."""
        known = starts.value
        out = []
        for key in map(_key, ids.to_pylist(), hashed.to_pylist()):
            found = bisect_right(known, key) - 1
            out.append([found] if known[found] != key else [found, -1 - (found - 1) % len(known)])
        return pa.array(out, pa.list_(pa.int32()))

    dealt = rows.withColumn("placed", F.explode(ranges_of("doc_id", "hashed")))
    dealt = dealt.select("doc_id", "text", "hashed", (F.col("placed") < 0).alias("guest"), F.when(F.col("placed") < 0, -1 - F.col("placed")).otherwise(F.col("placed")).alias("range"))
    ordered = dealt.repartition("range").sortWithinPartitions("range", "guest", F.col("doc_id").asc_nulls_last(), "hashed")
    fields = [rows.schema["doc_id"], *(T.StructField(n, t) for n, t in RESULT)]
    types = [to_arrow_type(f.dataType) for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None
        for batch in batches:
            for low in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(low, ROWS_AT_ONCE)
                out: list[tuple] = []
                for identity, body, number, guest in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    own = Fingerprint.of(paragraphs(body))
                    if held is not None and held[2] == number:
                        out.append(_compared(held[0], held[1], held[3], body, own))
                    held = None if guest else (identity, body, number, own)
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(v, type=t) for v, t in zip(zip(*out, strict=True), types, strict=True)], names=[f.name for f in fields])

    return ordered.select("doc_id", "text", "range", "guest").mapInArrow(run, T.StructType(fields))


RESULT = [
    ("n_chars", T.LongType()),
    ("edited_sha256", T.StringType()),
    ("fingerprint", T.StringType()),
    ("edited_fingerprint", T.StringType()),
    ("near_edited", T.DoubleType()),
    ("near_next", T.DoubleType()),
]


def _compared(identity, text: str, own: Fingerprint, following: str, following_print: Fingerprint) -> tuple:
    after, place = edited(text, following)
    changed = fingerprint_after_edit(own, text, after, place)
    digest = hashlib.sha256(after.encode()).hexdigest()
    return identity, len(text), digest, own.hex(), changed.hex(), own.likeness(changed), own.likeness(following_print)
