"""Fill-in-middle order of documents, with token counts of shared chunks remembered.

A token is a word with the white space before it, or white space at the end of
a text. To cut a document after its k-th token, its tokens must be counted, and
large corpora hold the same passages many times. So:

* a rolling hash over the last ``2 ** DOUBLINGS`` bytes cuts a text into
  chunks where the hash has its low bits clear, at starts of characters only;
  equal passages then give equal chunks wherever they stand;
* each chunk has a boundary summary: words that it holds a part of, code
  points, and whether its first and last byte belong to a word. A task keeps
  summaries by chunk hash; a hit counts only if the stored content is equal;
* summaries combine: words that go on over a boundary are counted once. Prefix
  sums name the chunk in which a cut lies, and that chunk alone is scanned.

What a task remembers is bounded by ``REMEMBERED_BYTES``; then it starts anew,
which costs time and never a result.

Defined results: a null text is an empty text, which stays plain; texts that
contain a sentinel stay plain, so every output can be taken apart again; a null
id draws like an empty one; equal rows get equal results; an empty table gives
an empty table; other columns are kept, and those named as an added one are
replaced.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from itertools import accumulate
from typing import NamedTuple

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.text import add_columns, utf8

SEED = 42
# Of a hundred documents so many are reordered, and of a hundred reordered ones so many start with the suffix.
RATE, SUFFIX_FIRST = 50, 80
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
# Bytes of a chunk: at least, at most, and on average between hash cuts.
LEAST, MOST, AVERAGE = 64, 8192, 512
# The rolling hash sees the last 2 ** DOUBLINGS bytes.
DOUBLINGS = 5
REMEMBERED_BYTES = 64_000_000

_GEAR = np.random.default_rng(SEED).integers(0, 1 << 32, 256, dtype=np.uint32)
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_SPACE = re.compile(rb"[\x20\x09-\x0D]")
_WHITE = frozenset(b" \t\n\v\f\r")

ADDED = T.StructType(
    [
        T.StructField("n", T.LongType()),
        T.StructField("form", T.StringType()),
        T.StructField("prefix_chars", T.LongType()),
        T.StructField("middle_chars", T.LongType()),
        T.StructField("output", T.StringType()),
    ]
)


def chunk_starts(data: bytes) -> list[int]:
    """Where chunks start: 0, then places that the bytes before them decide, and the end."""
    size = len(data)
    if size <= LEAST:
        return [0, size] if size else [0]
    values = np.frombuffer(data, dtype=np.uint8)
    rolled = _GEAR[values]
    # Each step doubles the bytes seen: what came before is shifted in.
    for k in range(DOUBLINGS):
        width = 1 << k
        rolled[width:] = rolled[width:] + (rolled[:-width] << np.uint32(width))
    character = (values & 0xC0) != 0x80
    cuts = (np.flatnonzero(((rolled[:-1] >> np.uint32(16)) % AVERAGE == 0) & character[1:]) + 1).tolist()
    starts = [0]
    for cut in [*cuts, size]:
        while cut - starts[-1] > MOST:
            forced = starts[-1] + MOST
            while not character[forced]:
                forced -= 1
            starts.append(forced)
        if cut - starts[-1] >= LEAST or cut == size:
            starts.append(cut)
    return starts


class Summary(NamedTuple):
    """Words a chunk holds (parts too), its code points, and whether it begins and ends inside a word."""

    words: int
    characters: int
    begins: bool
    ends: bool


def summarise(chunk: bytes) -> Summary:
    return Summary(len(chunk.split()), len(chunk.decode()), chunk[0] not in _WHITE, chunk[-1] not in _WHITE)


class ChunkMemory:
    """Summaries of chunks seen before, found by hash and verified by content."""

    def __init__(self, limit: int = REMEMBERED_BYTES):
        self.limit, self.held = limit, 0
        self.known: dict[int, tuple[bytes, Summary]] = {}
        self.counted = 0

    def summary(self, chunk: bytes) -> Summary:
        digest = xxhash.xxh3_64_intdigest(chunk)
        known = self.known.get(digest)
        if known is not None and known[0] == chunk:
            return known[1]
        self.counted += 1
        found = summarise(chunk)
        if known is None:
            if self.held > self.limit:
                self.known, self.held = {}, 0
            self.known[digest] = chunk, found
            self.held += len(chunk) + 200
        return found


class Counted:
    """A text with the combined counts of its chunks."""

    def __init__(self, data: bytes, memory: ChunkMemory):
        self.data = data
        self.starts = chunk_starts(data)
        self.parts = [memory.summary(data[a:b]) for a, b in zip(self.starts, self.starts[1:], strict=False)]
        # A word that goes on from the chunk before does not begin in this one.
        self.goes_on = [False, *(a.ends and b.begins for a, b in zip(self.parts, self.parts[1:], strict=False))]
        self.words = list(accumulate((p.words - on for p, on in zip(self.parts, self.goes_on, strict=False)), initial=0))
        self.characters = list(accumulate((p.characters for p in self.parts), initial=0))
        self.tokens = self.words[-1] + (1 if data and not self.parts[-1].ends else 0)

    def cut(self, tokens: int) -> int:
        """The byte place after so many tokens."""
        if tokens <= 0:
            return 0
        if tokens > self.words[-1]:
            return len(self.data)
        chunk = bisect_left(self.words, tokens) - 1
        within = tokens - self.words[chunk] + self.goes_on[chunk]
        begins = self.starts[chunk]
        for _, word in zip(range(within), _WORD.finditer(self.data, begins), strict=False):
            begins = word.start()
        after = _SPACE.search(self.data, begins)
        return after.start() if after else len(self.data)

    def characters_before(self, place: int) -> int:
        chunk = bisect_right(self.starts, place) - 1
        return self.characters[chunk] + len(self.data[self.starts[chunk] : place].decode())


def draws(doc_id, seed: int = SEED) -> list[int]:
    """Four unsigned numbers from a document's id."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[i : i + 8], 16) for i in (0, 8, 16, 24)]


def reorder(doc_id, text: str | None, memory: ChunkMemory, seed: int = SEED, rate: int = RATE, suffix_first: int = SUFFIX_FIRST) -> tuple:
    """(tokens, form, code points of prefix and middle, output) of a document."""
    counted = Counted(utf8(text), memory)
    n = counted.tokens
    h1, h2, h3, h4 = draws(doc_id, seed)
    if not text or h3 % 100 >= rate or any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE)):
        return n, "plain", None, None, text or ""
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    first, second = counted.cut(low), counted.cut(high)
    a = counted.characters_before(first)
    b = counted.characters_before(second)
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h4 % 100 < suffix_first:
        return n, "spm", a, b - a, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return n, "psm", a, b - a, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def fill_in_middle(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", seed: int = SEED, rate: int = RATE, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """Add n, form, prefix_chars, middle_chars and output."""

    def make():
        memory = ChunkMemory()

        def run(ids: list, texts: list) -> list[list]:
            rows = [reorder(d, t, memory, seed, rate, suffix_first) for d, t in zip(ids, texts, strict=True)]
            return [list(c) for c in zip(*rows, strict=True)] if rows else [[] for _ in ADDED.fields]

        return run

    return add_columns(docs, [doc_id, text], ADDED, make)


def restored(output: Column, form: Column) -> Column:
    """The text that an output of a form was made from."""
    # No part holds a sentinel, so the first of each kind is the one put there.
    psm = F.regexp_replace(output, rf"(?s)\A{PREFIX}(.*?){SUFFIX}(.*?){MIDDLE}(.*)\z", "$1$3$2")
    spm = F.regexp_replace(output, rf"(?s)\A{SUFFIX}(.*?){PREFIX}(.*?){MIDDLE}(.*)\z", "$2$3$1")
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def middle_report(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256)."""
    made = fill_in_middle(docs.select("doc_id", F.col("text").cast("string").alias("text")))
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )
