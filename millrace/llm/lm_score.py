"""Stupid-backoff scores of documents under a language model of the whole corpus.

The relations are those of the textbook: n-grams exploded from documents, count
tables partitioned by n-gram hash, counts joined back to the n-grams, scores
summed per document. They are kept in packed form, because single rows for
every n-gram would be many times the corpus: documents are dealt into blocks,
a block's distinct n-grams travel to their hash partition as one sorted array,
the partition adds the blocks' counts up, and the totals come back to the
block in the same order. Per n-gram a block sends one entry however often the
n-gram occurs, so a frequent n-gram is no hot key.

Counts leave the scored document out, else every n-gram would be known: with
counts c' over all other documents and N' words in them, a word w after u v
scores in a model of order 3

    c'(u v w) / c'(u v)       if u v w occurs elsewhere,
    BACKOFF * c'(v w) / c'(v) else if v w does,
    BACKOFF^2 * c'(w) / N'    else if w does, and BACKOFF^3 / N' else,

and likewise for every other order, one step for each word of context. A
document's first words have less context and start further down. N-grams are
told apart by 56-bit hashes: among 10^12 distinct ones, about one in 70,000 that
occur nowhere else is taken for one that does.

Defined results: null and empty texts have no words and a null score; a corpus
of one document has N' = 1; equal rows count as documents of their own; null
ids are kept; an empty table gives an empty table; other columns are not
carried.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.text import alnum_words

BACKOFF = 0.4
# Words of the longest n-grams.
ORDER = 3
BLOCK_BYTES = 5_000_000
PART_BYTES = 4_000_000
_MIX = np.uint64(0x9E3779B97F4A7C15)
# The entry that counts words; no n-gram hash is let be 0.
_TOTAL = np.uint64(0)
# Highest bits of a hash that are left out.
_CUT = np.uint64(8)


def _mixed(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    values ^= values >> np.uint64(32)
    values >>= _CUT
    return np.where(values == _TOTAL, np.uint64(1), values)


def packed(values: np.ndarray) -> bytes:
    """Ascending numbers as differences, byte plane by byte plane, so that equal high bytes stand together."""
    steps = np.diff(values, prepend=np.zeros(1, values.dtype))
    return np.ascontiguousarray(steps.view(np.uint8).reshape(-1, values.dtype.itemsize).T).tobytes()


def unpacked(data: bytes, dtype=np.uint64) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    steps = np.ascontiguousarray(np.frombuffer(data, dtype=np.uint8).reshape(size, -1).T).view(dtype).ravel()
    return np.cumsum(steps, dtype=dtype)


def planes(values: np.ndarray) -> bytes:
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes()


def from_planes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, dtype=np.uint8).reshape(8, -1).T).view("<u8").ravel().astype(np.int64)


def _sent(planes_: bytes) -> bytes:
    """Byte planes for the way; whole planes are nearly constant, which Spark's own codec makes less of."""
    return zstandard.ZstdCompressor(level=1).compress(planes_)


def _received(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def _numbered(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct values in order, where each value is among them, and how often each comes up."""
    order = np.argsort(values)
    ordered = values[order]
    new = np.ones(len(values), dtype=bool)
    new[1:] = ordered[1:] != ordered[:-1]
    place = np.empty(len(values), dtype=np.int32)
    place[order] = np.cumsum(new, dtype=np.int32) - 1
    starts = np.flatnonzero(new)
    return ordered[starts], place, np.diff(starts, append=len(values))


class Block:
    """The n-grams of a block's documents: distinct ones in hash order, and where those that end at each word are."""

    def __init__(self, texts: list[str | None], order: int = ORDER):
        numbers: dict[bytes, int] = {}
        sizes, ids = [], []
        for text in texts:
            words = alnum_words(text)
            sizes.append(len(words))
            ids.append(np.array([numbers.setdefault(w, len(numbers)) for w in words], dtype=np.int64))
        self.sizes = np.array(sizes, dtype=np.int64)
        word = np.concatenate(ids) if ids else np.zeros(0, np.int64)
        self.document = np.repeat(np.arange(len(sizes)), self.sizes)
        word_hash = np.fromiter((xxhash.xxh64_intdigest(w) for w in numbers), dtype=np.uint64, count=len(numbers))
        hashed = word_hash[word] if len(word) else np.zeros(0, np.uint64)
        within = np.arange(len(word)) - np.repeat(np.cumsum(self.sizes) - self.sizes, self.sizes)
        # For each order the words at which an n-gram ends, and its hash: that of one word less before, carried on.
        self.ends, grams, chain = [], [], hashed
        for k in range(1, order + 1):
            ends = np.flatnonzero(within >= k - 1)
            if k > 1:
                chain = chain * _MIX
                chain[1:] = chain[:-1] + hashed[1:]
            self.ends.append(ends)
            grams.append(_mixed(chain[ends] + np.uint64(k)))
        self.hashes, place, self.counts = _numbered(np.concatenate([np.array([_TOTAL]), *grams]))
        self.counts[place[0]] = len(word)
        self.total_place = int(place[0])
        self.places = np.split(place[1:], np.cumsum([len(e) for e in self.ends])[:-1])

    def counts_elsewhere(self, k: int, totals: np.ndarray) -> np.ndarray:
        """For each word how often the n-gram of ``k`` words that ends there comes up in other documents; 0 if none ends."""
        ends, places = self.ends[k - 1], self.places[k - 1]
        _, back, own = _numbered(self.document[ends] * np.int64(len(self.hashes)) + places)
        out = np.zeros(len(self.document), dtype=np.int64)
        out[ends] = totals[places] - own[back]
        return out

    def scores(self, totals: np.ndarray, backoff: float) -> list[float | None]:
        """Mean log10 score of a word for each document, from corpus counts in the order of ``hashes``."""
        order = len(self.ends)
        context = np.maximum(1, totals[self.total_place] - self.sizes)[self.document]
        score = backoff**order / context
        for k in range(1, order + 1):
            here = self.counts_elsewhere(k, totals)
            seen = np.flatnonzero(here)
            # A longer n-gram that occurs elsewhere replaces what the shorter ones say.
            score[seen] = backoff ** (order - k) * here[seen] / context[seen]
            context = np.concatenate([context[:1], here[:-1]])
        sums = np.bincount(self.document, weights=np.log10(score), minlength=len(self.sizes))
        return [float(s) / n if n else None for s, n in zip(sums.tolist(), self.sizes.tolist(), strict=True)]


def _parts(hashes: np.ndarray, parts: int) -> np.ndarray:
    """Hash partition of each n-gram; ascending hashes have ascending partitions."""
    return ((hashes >> (np.uint64(32) - _CUT)) * np.uint64(parts)) >> np.uint64(32)


def score_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", backoff: float = BACKOFF, order: int = ORDER, block_bytes: int = BLOCK_BYTES, part_bytes: int = PART_BYTES) -> DataFrame:
    """Rows (doc_id, n_words, score): mean log10 stupid-backoff score of a word of each document under n-grams of up to ``order`` words."""
    if order < 1:
        raise ValueError("order must be 1 or more")
    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    size = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks, parts = max(1, math.ceil(size / block_bytes)), max(1, math.ceil(size / part_bytes))
    # The exchange by block is one for both uses of it.
    dealt = source.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("long")).repartition("block")

    def explode(key: tuple, table: pa.Table) -> pa.Table:
        block = Block(table.column("text").to_pylist(), order)
        cuts = np.searchsorted(_parts(block.hashes, parts), np.arange(parts + 1))
        rows = [(p, _sent(packed(block.hashes[a:b])), _sent(planes(block.counts[a:b]))) for p, (a, b) in enumerate(zip(cuts.tolist(), cuts[1:].tolist(), strict=False)) if b > a]
        part, hashes, counts = zip(*rows, strict=True)
        return pa.table({"part": pa.array(part, pa.int64()), "block": pa.array([key[0].as_py()] * len(part), pa.int64()), "hashes": pa.array(hashes, pa.binary()), "counts": pa.array(counts, pa.binary())})

    def add_up(key: tuple, table: pa.Table) -> pa.Table:
        arrays = [unpacked(_received(h)) for h in table.column("hashes").to_pylist()]
        counts = np.concatenate([from_planes(_received(c)) for c in table.column("counts").to_pylist()])
        _, place, _ = _numbered(np.concatenate(arrays))
        totals = np.bincount(place, weights=counts).astype(np.int64)[place]
        ends = np.cumsum([len(a) for a in arrays])
        out = [_sent(planes(t)) for t in np.split(totals, ends[:-1])]
        return pa.table({"part": pa.array([key[0].as_py()] * len(out), pa.int64()), "block": table.column("block").combine_chunks(), "totals": pa.array(out, pa.binary())})

    def score(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        block = Block(left.column("text").to_pylist(), order)
        by_part = np.argsort(np.array(right.column("part").to_pylist()))
        given = right.column("totals").to_pylist()
        totals = np.concatenate([from_planes(_received(given[i])) for i in by_part.tolist()])
        return pa.table({"doc_id": left.column("doc_id").combine_chunks(), "n_words": pa.array(block.sizes, pa.int64()), "score": pa.array(block.scores(totals, backoff), pa.float64())})

    grams = dealt.groupBy("block").applyInArrow(explode, "part long, block long, hashes binary, counts binary")
    totals = grams.groupBy("part").applyInArrow(add_up, "part long, block long, totals binary")
    schema = T.StructType([source.schema["doc_id"], T.StructField("n_words", T.LongType()), T.StructField("score", T.DoubleType())])
    return dealt.groupBy("block").cogroup(totals.groupBy("block")).applyInArrow(score, schema)
