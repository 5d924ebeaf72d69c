"""Best-two-fit packing of tokenised documents into sequences of fixed length.

A document is its token ids and an end id. A longer one than a sequence is cut
into full pieces, and its first piece takes the odd rest. Which pieces share a
sequence depends on lengths only, and there are at most ``capacity`` of them,
so the plan is made on the counts per length:

* fill a bin greedily, each time with the longest piece that fits;
* then look at the bin's smallest piece: if two unpacked pieces fit the gap
  that its removal leaves more tightly than it does, they replace it;
* repeat the bin as often as the counts allow.

Every plan step uses a length up, so there are no more steps than lengths. The
pieces of a length are then numbered, in blocks, and looked up in the plan:
nothing but counts reaches the driver, and no length has to fit one task.

Defined results: a null or empty text is the end id alone; equal rows are
packed each on its own; null ids are kept; an empty table gives an empty table;
other columns are not carried.
"""

from __future__ import annotations

import gc
import math
import os
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.session import settle

CAPACITY = 1024
END_ID = 2
# Distinct words whose ids a task remembers, some 200 bytes each.
REMEMBERED = 800_000
# Texts that are taken apart together.
TEXTS_TOGETHER = 400
# Pieces that are numbered together in one task.
NUMBERED_TOGETHER = 200_000
# ASCII punctuation but the apostrophe, which the tokenizer takes together with some letters.
MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
# The characters that stand for the bytes of a text in byte-level merges.
_KEPT_BYTES = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_BYTE_LETTERS = {b: chr(0x100 + k) for k, b in enumerate(b for b in range(0x100) if b not in _KEPT_BYTES)}


def of_letters(word: str) -> bool:
    """Whether a word is letters that any version of Unicode has, so that the tokenizer takes it in one piece."""
    return word.isalpha() and (word.isascii() or max(word) < "\u0250")


class WordCache:
    """Token ids of texts word by word, as little-endian unsigned 32-bit numbers.

    The tokenizer always splits before a single space and around a single line
    feed, so the ids of a text are those of its words, each with its space. A
    word that ends in a full stop or comma has the ids of the word and the
    mark. Texts with any other white space are encoded whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        # Tasks take every core already; threads of their own only cost more time on them.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.first: dict[str, bytes]
        self.spaced: dict[str, bytes]
        self.runs: dict[str, bytes]
        self.forget()
        self.feed = self.direct("\n")
        self.model = self.tokenizer.model
        some = ["word", "Straße", "année", "Łódź"]
        self.merges_alone = all(self._merged(some, space) == [self.direct(space + w) for w in some] for space in ("", " "))

    def direct(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _encoded(self, words: list[str], space: str) -> list[bytes]:
        """Ids of each word, encoded many to a line feed-separated text."""
        out: list[bytes] = []
        texts = ["\n".join([space + w for w in words[i : i + 256]]) for i in range(0, len(words), 256)]
        (feed,) = np.frombuffer(self.feed, dtype="<u4").tolist()
        for encoded in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False):
            ids = np.array(encoded.ids, dtype="<u4")
            data = ids.tobytes()
            cuts = (4 * np.flatnonzero(ids == feed)).tolist()
            out += [data[a:b] for a, b in zip([0, *(c + 4 for c in cuts)], [*cuts, len(data)], strict=True)]
        return out

    def _merged(self, words: list[str], space: str) -> list[bytes]:
        """Ids of words of letters: each is one piece, so its merges are all there is to do."""
        lead = _BYTE_LETTERS[ord(" ")] if space else ""
        merge = self.model.tokenize
        ids = [[t.id for t in merge(lead + (w if w.isascii() else w.encode().decode("latin-1").translate(_BYTE_LETTERS)))] for w in words]
        data = np.array(list(chain.from_iterable(ids)), dtype="<u4").tobytes()
        ends = list(accumulate([4 * len(i) for i in ids]))
        return [data[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    def _learn(self, known: dict[str, bytes], words: set[str], space: str) -> None:
        ends = {w: stem for w in words if w[-1] in MARKS and (stem := w.rstrip(MARKS))[-1:].isalpha()}
        whole = [w for w in words.difference(ends).union(ends.values()) if w not in known]
        if self.merges_alone:
            plain = [w for w in whole if of_letters(w)]
            known.update(zip(plain, self._merged(plain, space), strict=True))
            whole = [w for w in whole if w not in known]
        known.update(zip(whole, self._encoded(whole, space), strict=True))
        runs = self.runs
        for word, stem in ends.items():
            run = word[len(stem) :]
            if run not in runs:
                runs[run] = self.direct(run)
            known[word] = known[stem] + runs[run]

    @staticmethod
    def _split(text: str) -> list[list[str]] | None:
        """Words by line, or None if any white space is not a single space or line feed."""
        lines = text.split("\n")
        split = []
        for i, line in enumerate(lines):
            words = line.split()
            if not words or " ".join(words) != line:
                if line or 0 < i < len(lines) - 1:
                    return None
                words = [""]
            split.append(words)
        return split

    def forget(self) -> None:
        """Give up the remembered words."""
        self.first, self.spaced, self.runs = {"": b""}, {}, {}

    def encode(self, texts: list[str]) -> list[bytes]:
        if len(self.spaced) > REMEMBERED:
            self.forget()
        first, spaced = self.first, self.spaced
        # A line is its ids, or while some of them are to be learnt its words, their ids so far, and the places without.
        found: list[list[bytes | tuple] | None] = []
        new_first: set[str] = set()
        new_spaced: set[str] = set()
        joined = b"".join
        for text in texts:
            split = self._split(text)
            if split is None:
                found.append(None)
                continue
            lines: list[bytes | tuple] = []
            for words in split:
                ids = list(map(spaced.get, words))
                ids[0] = first.get(words[0])
                try:
                    lines.append(joined(ids))
                except TypeError:
                    missing = [k for k, known in enumerate(ids) if known is None]
                    if missing[0] == 0:
                        new_first.add(words[0])
                        del missing[0]
                    new_spaced.update([words[k] for k in missing])
                    lines.append((words, ids, missing))
            found.append(lines)
        self._learn(first, new_first, "")
        self._learn(spaced, new_spaced, " ")
        out = []
        for text, lines in zip(texts, found, strict=True):
            if lines is None:
                out.append(self.direct(text))
                continue
            for place, line in enumerate(lines):
                if type(line) is tuple:
                    words, ids, missing = line
                    for k in missing:
                        ids[k] = spaced[words[k]]
                    if ids[0] is None:
                        ids[0] = first[words[0]]
                    lines[place] = joined(ids)
            out.append(self.feed.join(lines))
        return out


def default_tokenizer() -> str:
    """The installed byte-level vocabulary; executors have it at the same place."""
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


_caches: dict[str, WordCache] = {}


def _cache(path: str) -> WordCache:
    if path not in _caches:
        _caches[path] = WordCache(path)
    return _caches[path]


def tokenised(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Rows (doc_id, piece, start, length, ids_crc32[, ids]): the pieces of every document."""
    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    key = source.schema["doc_id"]
    fields = [T.StructField("doc_id", key.dataType), T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType())]
    if with_ids:
        fields.append(T.StructField("ids", T.BinaryType()))
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = _cache(tokenizer)
        try:
            for batch in batches:
                for low in range(0, batch.num_rows, TEXTS_TOGETHER):
                    part = batch.slice(low, TEXTS_TOGETHER)
                    # Lists of words make no cycles, so looking through them for some is in vain.
                    gc.disable()
                    try:
                        encoded = cache.encode([t or "" for t in part.column(1).to_pylist()])
                    finally:
                        gc.enable()
                    owners, pieces, starts, lengths, sums, bodies = [], [], [], [], [], []
                    for owner, ids in enumerate(encoded):
                        ids += end
                        n = len(ids) // 4
                        cut = n % capacity or capacity
                        bounds = [0, *range(cut, n + 1, capacity)]
                        for k, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False)):
                            owners.append(owner)
                            pieces.append(k)
                            starts.append(a)
                            lengths.append(b - a)
                            sums.append(zlib.crc32(ids[4 * a : 4 * b]))
                            if with_ids:
                                bodies.append(ids[4 * a : 4 * b])
                    columns = [part.column(0).take(pa.array(owners, pa.int64())), pa.array(pieces, pa.int32()), *(pa.array(v, pa.int64()) for v in (starts, lengths, sums))]
                    if with_ids:
                        columns.append(pa.array(bodies, pa.binary()))
                    yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in fields])
        finally:
            # An idle worker would keep them while other stages need the memory.
            cache.forget()

    return source.mapInArrow(run, T.StructType(fields))


@dataclass(frozen=True)
class Bin:
    """A combination of lengths, longest first, and how many sequences have it."""

    lengths: tuple[int, ...]
    times: int


def _best_two(available: list[int], counts: dict[int, int], room: int, over: int) -> tuple[int, int] | None:
    """Two unpacked lengths with the largest sum that is at most ``room`` and more than ``over``."""
    best, chosen = over, None
    for a in reversed(available):
        if a >= room or 2 * a <= best:
            if 2 * a <= best:
                break
            continue
        i = bisect_right(available, min(a, room - a)) - 1
        if i >= 0 and available[i] == a and counts[a] < 2:
            i -= 1
        if i >= 0 and a + available[i] > best:
            best, chosen = a + available[i], (a, available[i])
            if best == room:
                break
    return chosen


def plan_bins(counts: dict[int, int], capacity: int = CAPACITY) -> list[Bin]:
    """Bins for a number of pieces of each length."""
    counts = {k: v for k, v in counts.items() if v > 0}
    available = sorted(counts)
    plan = []
    while available:
        gap, chosen = capacity, []
        while gap:
            i = bisect_right(available, gap) - 1
            while i >= 0 and counts[available[i]] <= chosen.count(available[i]):
                i -= 1
            if i < 0:
                break
            chosen.append(available[i])
            gap -= available[i]
        if gap and len(chosen) > 1:
            smallest = chosen[-1]
            left = {k: v - chosen.count(k) for k, v in counts.items()}
            pair = _best_two([k for k in available if left[k] > 0], left, gap + smallest, smallest)
            if pair:
                chosen[-1:] = pair
        used = {k: chosen.count(k) for k in chosen}
        times = min(counts[k] // n for k, n in used.items())
        plan.append(Bin(tuple(sorted(chosen, reverse=True)), times))
        for k, n in used.items():
            counts[k] -= times * n
        available = [k for k in available if counts[k] > 0]
    return plan


def _slots(plan: list[Bin]) -> dict[int, list[tuple[int, int, int, int]]]:
    """For each length its places in plan order: (first number, first sequence, copies in a bin, place of the first copy)."""
    slots: dict[int, list[tuple[int, int, int, int]]] = {}
    taken: dict[int, int] = {}
    sequence = 0
    for planned in plan:
        place = 0
        for length in dict.fromkeys(planned.lengths):
            n = planned.lengths.count(length)
            slots.setdefault(length, []).append((taken.get(length, 0), sequence, n, place))
            taken[length] = taken.get(length, 0) + n * planned.times
            place += n * length
        sequence += planned.times
    return slots


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add sequence_id and offset to written pieces with a ``length`` of 1 to ``capacity``."""
    pieces = pieces.withColumn("salt", F.xxhash64("doc_id", "piece"))
    total = pieces.count()
    salts = max(1, math.ceil(total / NUMBERED_TOGETHER)) * 16
    salted = pieces.withColumn("salt", F.pmod("salt", F.lit(salts)).cast("int"))
    sizes = settle(salted.groupBy("length", "salt").count(), "piece-counts")
    counts = {r.length: r.n for r in sizes.groupBy("length").agg(F.sum("count").alias("n")).collect()}
    slots = pieces.sparkSession.sparkContext.broadcast(_slots(plan_bins(counts, capacity)))
    first = F.sum("count").over(_by("length", "salt")) - F.col("count")
    firsts = sizes.select(F.col("length").alias("of_length"), F.col("salt").alias("of_salt"), first.alias("first"))
    ranked = salted.withColumn("place", F.row_number().over(_by(["length", "salt"], "doc_id", "piece", "start", "ids_crc32")) - 1)
    numbered = ranked.join(firsts, (F.col("length") == F.col("of_length")) & (F.col("salt") == F.col("of_salt"))).select(
        *[c for c in pieces.columns if c != "salt"], (F.col("first") + F.col("place")).alias("number")
    )
    schema = T.StructType([f for f in numbered.schema.fields if f.name != "number"] + [T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = {k: np.array(v, dtype=np.int64) for k, v in slots.value.items()}
        for batch in batches:
            lengths = batch.column("length").to_numpy(zero_copy_only=False)
            numbers = batch.column("number").to_numpy(zero_copy_only=False)
            sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
            for length in np.unique(lengths).tolist():
                mine = lengths == length
                table = tables[length]
                slot = table[np.searchsorted(table[:, 0], numbers[mine], side="right") - 1]
                within = numbers[mine] - slot[:, 0]
                sequence[mine] = slot[:, 1] + within // slot[:, 2]
                offset[mine] = slot[:, 3] + within % slot[:, 2] * length
            columns = [batch.column(n) for n in batch.schema.names if n != "number"]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sequence), pa.array(offset)], names=schema.fieldNames())

    return numbered.mapInArrow(placed, schema)


def _by(keys, *order):
    from pyspark.sql import Window

    return Window.partitionBy(keys).orderBy(*order)


def pack_documents(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """The pieces of all documents with their sequences and offsets."""
    return pack(settle(tokenised(docs, tokenizer, doc_id, text, capacity, end_id, with_ids), "pieces"), capacity)
