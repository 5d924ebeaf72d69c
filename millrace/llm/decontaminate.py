"""Benchmark decontamination: a broadcast set of test n-grams against every training window.

Benchmark items become windows of ``window`` words (an item of fewer words is
one window). The windows are broadcast in blocks of at most ``block_words``
words, so a larger benchmark means more passes and never a larger broadcast.
A task turns each text into numbers (0 for a word no item has), looks rolling
hashes of windows without a 0 up in the block's hashes, and confirms each hit
by comparing the words.

Defined results: null and empty texts have no words and no hits; null ids are
kept; an item listed twice counts once, one without an id counts as ''; an
empty benchmark hits nothing; equal rows are judged each on its own; other
columns stay. ``scan_windows`` replaces columns named as an added one; the
operators that add none keep them.
"""

from __future__ import annotations

import hashlib
import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.text import ALNUM_WORD, add_columns, alnum_words, lowered, sheltered
from millrace.session import settle

WINDOW = 13
BLOCK_WORDS = 1_000_000
# Words of an item that go in one piece; longer items are cut with an overlap of a window less one word.
PIECE_WORDS = 50_000

ADDED = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("hit_words", T.ArrayType(T.StructType([T.StructField("first", T.LongType()), T.StructField("last", T.LongType())]))),
        T.StructField("hit_spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
        T.StructField("hit_items", T.ArrayType(T.StringType())),
    ]
)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def _powers(base: np.uint64, count: int) -> np.ndarray:
    out = np.full(count, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def window_hashes(numbers: np.ndarray, length: int) -> np.ndarray:
    """One hash for each run of ``length`` numbers; equal runs have equal hashes."""
    n = len(numbers)
    if n < length:
        return np.zeros(0, dtype=np.uint64)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(numbers.astype(np.uint64) * _powers(_BASE, n), out=sums[1:])
    return (sums[length:] - sums[:-length]) * _powers(_INVERSE, n - length + 1)


class WindowIndex:
    """The windows of some benchmark pieces, by length."""

    def __init__(self, pieces: list[tuple[str, list[bytes]]], window: int):
        self.numbers: dict[bytes, int] = {}
        self.items: dict[int, dict[bytes, set[str]]] = defaultdict(lambda: defaultdict(set))
        for item, words in pieces:
            numbers = np.array([self.numbers.setdefault(w, len(self.numbers) + 1) for w in words], dtype=np.int32)
            length = min(window, len(numbers))
            for i in range(len(numbers) - length + 1 if length else 0):
                self.items[length][numbers[i : i + length].tobytes()].add(item)
        self.items = {k: dict(v) for k, v in self.items.items()}
        self.hashes = {k: self._hashed(k) for k in self.items}

    def _hashed(self, length: int) -> np.ndarray:
        rows = np.frombuffer(b"".join(self.items[length]), dtype=np.int32).reshape(-1, length)
        return np.unique((rows.astype(np.uint64) * _powers(_BASE, length)).sum(axis=1, dtype=np.uint64))

    def hits(self, words: list[bytes]) -> tuple[np.ndarray, set[str]]:
        """For each word whether an occurring window covers it; the items those windows belong to."""
        get = self.numbers.get
        numbers = np.array([get(w, 0) for w in words], dtype=np.int32)
        edges = np.zeros(len(words) + 1, dtype=np.int64)
        found: set[str] = set()
        unknown = np.concatenate(([0], np.cumsum(numbers == 0)))
        for length, known in self.hashes.items():
            if len(words) < length:
                continue
            whole = np.flatnonzero(unknown[length:] == unknown[:-length])
            if not len(whole):
                continue
            # Hash only from the first to the last run of known words.
            low, high = int(whole[0]), int(whole[-1]) + length
            hashes = window_hashes(numbers[low:high], length)[whole - low]
            at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
            for i in whole[known[at] == hashes].tolist():
                owners = self.items[length].get(numbers[i : i + length].tobytes())
                if owners:
                    edges[i] += 1
                    edges[i + length] -= 1
                    found |= owners
        return np.cumsum(edges[:-1]) > 0, found


def runs(mask: np.ndarray) -> list[tuple[int, int]]:
    """First and one past the last position of each run of true values."""
    padded = np.concatenate(([0], mask.astype(np.int8), [0]))
    steps = np.diff(padded)
    return list(zip(np.flatnonzero(steps == 1).tolist(), np.flatnonzero(steps == -1).tolist(), strict=True))


def benchmark_pieces(benchmark: DataFrame, item_id: str, text: str, window: int) -> DataFrame:
    """Rows (item, words, n): items cut into bounded pieces that together have every window once or more."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for item, body in zip(batch["item"], batch["text"], strict=True):
                words = alnum_words(body)
                for i in range(0, max(1, len(words) - window + 1), PIECE_WORDS):
                    part = words[i : i + PIECE_WORDS + window - 1]
                    if part:
                        rows.append((item, b" ".join(part).decode("utf-8"), len(part)))
            yield pd.DataFrame(rows, columns=["item", "words", "n"])

    source = benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("item"), F.col(text).cast("string").alias("text"))
    return source.mapInPandas(cut, "item string, words string, n long")


def _scanner(index):
    def make():
        windows: WindowIndex = index.value

        def scan(texts: list, *earlier: list) -> list[list]:
            columns: list[list] = [[], [], [], []]
            for row, body in enumerate(texts):
                data = lowered(body)
                words = ALNUM_WORD.findall(data)
                mask, items = windows.hits(words)
                if earlier:
                    for span in earlier[0][row]:
                        mask[span["first"] : span["last"] + 1] = True
                    items = items | set(earlier[1][row])
                found = runs(mask)
                at = [m.span() for m in ALNUM_WORD.finditer(data)] if found else []
                columns[0].append(len(words))
                columns[1].append([{"first": a, "last": b - 1} for a, b in found])
                columns[2].append([{"start": len(data[: at[a][0]].decode()), "end": len(data[: at[b - 1][1]].decode())} for a, b in found])
                columns[3].append(sorted(items))
            return columns

        return scan

    return make


def scan_windows(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Add n_words, hit_words (runs of hit word numbers), hit_spans (the same in code points) and hit_items to every document."""
    spark = docs.sparkSession
    pieces = settle(benchmark_pieces(benchmark, item_id, item_text, window), "benchmark-pieces")
    total = pieces.agg(F.sum("n")).first()[0] or 0
    blocks = max(1, math.ceil(total / block_words))
    numbered = pieces.withColumn("block", F.pmod(F.xxhash64("item", "words"), F.lit(blocks)))
    docs = docs.drop(*ADDED.fieldNames())
    for block in range(blocks):
        rows = numbered.where(F.col("block") == block).select("item", "words").collect()
        index = spark.sparkContext.broadcast(WindowIndex([(r.item, r.words.encode().split(b" ")) for r in rows], window))
        earlier = ["hit_words", "hit_items"] if block else []
        docs = add_columns(docs, [text, *earlier], ADDED, _scanner(index))
        if blocks > 1:
            docs = settle(docs, "decontaminate-block")
    return docs


def hit_count() -> Column:
    return F.aggregate("hit_words", F.lit(0).cast("long"), lambda n, s: n + s["last"] - s["first"] + 1)


def is_contaminated() -> Column:
    """Any hit, and at least a twentieth of the words hit."""
    return (hit_count() > 0) & (20 * hit_count() >= F.col("n_words"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **names) -> DataFrame:
    """The documents that are not contaminated, unchanged."""
    docs, back = sheltered(docs, ADDED.fieldNames())
    return scan_windows(docs, benchmark, **names).where(~is_contaminated()).select(*back)


def cut_spans(docs: DataFrame, benchmark: DataFrame, text: str = "text", **names) -> DataFrame:
    """All documents, with the hit spans cut out of their texts."""
    docs, back = sheltered(docs, ADDED.fieldNames())
    found = scan_windows(docs, benchmark, text=text, **names)
    whole = F.col(text)
    pieces = F.transform(
        "hit_spans",
        lambda s, i: F.substring(whole, F.when(i == 0, 1).otherwise(F.get("hit_spans", i - 1)["end"] + 1).cast("int"),
                                 (s["start"] - F.when(i == 0, 0).otherwise(F.get("hit_spans", i - 1)["end"])).cast("int")),
    )
    rest = F.substring(whole, (F.element_at("hit_spans", -1)["end"] + 1).cast("int"), F.length(whole))
    cleaned = F.when(F.size("hit_spans") > 0, F.concat(F.array_join(pieces, ""), rest)).otherwise(whole)
    return found.withColumn(text, cleaned).select(*back)


def contamination_report(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Counts, a digest of the items, and the verdict for every document."""
    found = scan_windows(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), benchmark)
    return found.select(
        "doc_id",
        "n_words",
        hit_count().alias("n_hit"),
        F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("hit_items", ","), 256).alias("items_sha256"),
        is_contaminated().alias("contaminated"),
    )
