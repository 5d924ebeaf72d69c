"""Removal of repeated passages with difference-cover suffix sorting.

Every byte under a string of ``WINDOW`` bytes that also starts in a document
with a smaller id is removed. Sorting all suffixes of a corpus would move many
times its size, so suffixes are first dealt out, losing none that matter:

1. The anchor of a window is the smallest hash of its ``GRAM``-byte strings,
   mixed once more so that anchors spread evenly over partitions. Equal windows
   have equal anchors, so windows whose anchor comes up in one document alone
   cannot repeat. Blocks of documents send their distinct anchors to hash
   partitions, which answer which are shared.
2. Of stretches of windows with one shared anchor, 64-bit digests and the
   smallest id go to the partition of that anchor first. A stretch that a
   smaller id has too repeats as a whole; one whose anchor has no other text
   cannot repeat. Only the smallest ids of anchors with different texts are
   asked for bytes.
3. Those travel to partitions by anchor; stretches of anchors with very many
   different texts are split further, by the window's own hash. There the
   suffixes are sorted by the difference cover modulo 3: triples at sampled
   places are sorted and named, the names are sorted by the same method until
   they span a window, the remaining suffixes are sorted by their first byte and
   their successor's rank and merged in, and the ``WINDOW``-byte prefixes of
   neighbours are compared, byte for byte.
4. For each window the partition answers whether a smaller id has it, and the
   block marks what it covers.

Of a text that many documents share, each block sends one digest and one block
its bytes, so it is no hot group. Ids may be of any type that orders.

Defined results: null and empty texts have no bytes; of rows with one id none
is smaller than the other, so they don't remove each other; rows without an id
are kept whole and remove nothing; an empty table gives an empty table; other
columns are not carried.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.lm_score import from_planes, packed, planes, unpacked
from millrace.llm.text import utf8

WINDOW = 50
GRAM = 20
BLOCK_BYTES = 5_000_000
PART_BYTES = 6_000_000
# Text per partition of suffix sorting, which needs some hundred bytes of memory for each byte of a stretch.
SORT_BYTES = 1_000_000
# Stretches asked of an anchor's blocks before its windows are dealt out one by one.
SPREAD_BLOCKS = 64
# Windows of a stretch, at most: an answer has 63 bits.
PIECE = 63
# The bits of a hash that name an anchor. Strings that share them only meet in vain.
_ANCHOR_BITS = np.uint64(0xFFFFFFFFFFFF0000)
# Windows that are hashed together.
CHUNK = 1 << 18
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


# Suffix sorting


def _named(*columns: np.ndarray) -> np.ndarray:
    """Ranks from 1 of the rows of several columns of small numbers; equal rows share one."""
    key = columns[0].astype(np.int64)
    for column in columns[1:]:
        top = int(column.max(initial=0)) + 1
        if int(key.max(initial=0)) >= (1 << 62) // top:
            key = np.unique(key, return_inverse=True)[1]
        key = key * top + column
    return np.unique(key, return_inverse=True)[1] + 1


def suffix_order(symbols: np.ndarray, reach: int, spanned: int = 1) -> np.ndarray:
    """Places of ``symbols`` in the order of their suffixes, decided by at least ``reach`` symbols of the first level.

    ``spanned`` is how many of those one symbol stands for. Suffixes that agree
    that far stand together, in any order.
    """
    n = len(symbols)
    if n < 3:
        return np.array(sorted(range(n), key=lambda i: symbols[i:].tolist()), dtype=np.int64)
    pad = 3 + (n % 3 == 1)
    s = np.concatenate([symbols.astype(np.int64), np.zeros(pad, np.int64)])
    length = n + (n % 3 == 1)
    one, two, rest = (np.arange(k, length, 3) for k in (1, 2, 0))
    sample = np.concatenate([one, two])
    names = _named(s[sample], s[sample + 1], s[sample + 2])
    if int(names.max()) == len(sample) or 3 * spanned >= reach:
        by_name = np.argsort(names, kind="stable")
    else:
        by_name = suffix_order(names, reach, 3 * spanned)
    rank = np.zeros(length + 3, dtype=np.int64)
    rank[sample[by_name]] = np.arange(1, len(sample) + 1)
    top = len(sample) + 2
    rest = rest[np.argsort(s[rest] * top + rank[rest + 1], kind="stable")]
    sampled = sample[by_name]
    # A remaining suffix meets sampled ones of both kinds at a place where both successors are ranked.
    of_one = sampled[sampled % 3 == 1]
    of_two = sampled[sampled % 3 == 2]
    rest_one, rest_two = s[rest] * top + rank[rest + 1], _named_pairs(s, rank, rest, of_two, top)
    before = np.searchsorted(s[of_one] * top + rank[of_one + 1], rest_one) + np.searchsorted(rest_two[1], rest_two[0])
    place = np.zeros(length, dtype=np.int64)
    place[rest] = before + np.arange(len(rest))
    less = np.zeros(length, dtype=np.int64)
    less[of_one] = np.searchsorted(rest_one, s[of_one] * top + rank[of_one + 1], side="right")
    less[of_two] = np.searchsorted(rest_two[0], rest_two[1], side="right")
    place[sampled] = np.arange(len(sampled)) + less[sampled]
    order = np.argsort(place, kind="stable")
    return order[order < n]


def _named_pairs(s: np.ndarray, rank: np.ndarray, rest: np.ndarray, of_two: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray]:
    """Comparable keys (symbol, symbol, rank two on) of remaining suffixes and of those sampled at 2 modulo 3."""
    both = np.concatenate([rest, of_two])
    pair = _named(s[both], s[both + 1])
    key = pair * top + rank[both + 2]
    return key[: len(rest)], key[len(rest) :]


def equal_windows(data: bytes, starts: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """A class number for each start: equal for equal ``window``-byte strings, found by sorting suffixes."""
    symbols = np.frombuffer(data, dtype=np.uint8).astype(np.int64) + 1
    order = suffix_order(symbols, window)
    wanted = np.full(len(symbols) + 1, -1, dtype=np.int64)
    wanted[starts] = np.arange(len(starts))
    mine = wanted[order]
    sorted_starts = mine[mine >= 0]
    padded = np.frombuffer(data + b"\0" * 8, dtype=np.uint8)
    words = np.lib.stride_tricks.sliding_window_view(padded, 8)
    at = starts[sorted_starts]
    differs = np.zeros(max(0, len(at) - 1), dtype=bool)
    for shift in [*range(0, window - 8, 8), window - 8]:
        eight = np.ascontiguousarray(words[at + shift]).view(np.uint64).ravel()
        differs |= eight[1:] != eight[:-1]
    classes = np.zeros(len(starts), dtype=np.int64)
    classes[sorted_starts] = np.concatenate([[0], np.cumsum(differs)]) if len(at) else 0
    return classes


# Anchors


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out, out=out)


def _sums(data: np.ndarray) -> np.ndarray:
    """Sums of the bytes before each place, each times a power for its place."""
    terms = _powers(_BASE, len(data))
    terms *= data.astype(np.uint64) + np.uint64(1)
    out = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(terms, out=out[1:])
    return out


def _mixed(values: np.ndarray) -> np.ndarray:
    values ^= values >> np.uint64(29)
    values *= np.uint64(0xBF58476D1CE4E5B9)
    values ^= values >> np.uint64(32)
    return values


def _hashes(data: np.ndarray, length: int) -> np.ndarray:
    """A well-mixed hash of every ``length``-byte string."""
    sums = _sums(data)
    out = sums[length:] - sums[:-length]
    out *= _powers(_INVERSE, len(out))
    return _mixed(out)


def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every run of ``width`` values."""
    n = len(values)
    full = -(-n // width) * width
    padded = np.concatenate([values, np.full(full - n, np.iinfo(np.uint64).max, dtype=np.uint64)]).reshape(-1, width)
    ahead = np.minimum.accumulate(padded, axis=1).ravel()
    behind = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


class Block:
    """The distinct texts of a block, end to end, with the anchors of their windows.

    A stretch is a run of at most ``PIECE`` windows with one anchor inside a
    document: ``first`` is where its first window starts, ``count`` its windows,
    ``document`` the number of its text. Windows are read ``chunk`` at a time, so
    only stretches are held for the whole block.
    """

    def __init__(self, ids: list, texts: list[str | None], window: int, gram: int, chunk: int = CHUNK):
        self.window, self.chunk = window, chunk
        self.rows = list(zip(ids, [utf8(t) for t in texts], strict=True))
        # Of equal texts, the smallest id stands for all; rows without an id take no part.
        self.least: dict[bytes, object] = {}
        for owner, body in self.rows:
            if owner is not None and len(body) >= window and (body not in self.least or owner < self.least[body]):
                self.least[body] = owner
        # In an order of their own, for rows come in any order and a block is read more than once.
        self.least = dict(sorted(self.least.items()))
        self.data = b"".join(self.least)
        sizes = np.array([len(b) for b in self.least], dtype=np.int64)
        self.ends = np.cumsum(sizes)
        self.number = {body: k for k, body in enumerate(self.least)}
        found = [self._chunk(at, gram) for at in range(0, len(self.data) - window + 1, chunk)]
        self.first, self.count, self.anchor = (np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64))
        self.document = self.documents(self.first)

    def documents(self, places: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.ends, places, side="right")

    def _chunk(self, at: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        data = np.frombuffer(self.data, dtype=np.uint8)[at : at + self.chunk + self.window - 1]
        anchor = _sliding_min(_hashes(data, gram), self.window - gram + 1)
        inside = np.ones(len(anchor), dtype=bool)
        low, high = np.searchsorted(self.ends, [at, at + len(anchor) + self.window])
        for end in self.ends[low:high].tolist():
            inside[max(0, end - self.window + 1 - at) : max(0, end - at)] = False
        starts = np.flatnonzero(inside)
        anchor = anchor[starts]
        new = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (np.diff(starts) != 1)])) if len(starts) else np.zeros(0, np.int64)
        # Smallest hashes crowd at small numbers, so they are mixed again: partitions are ranges of anchors.
        first, count, anchor = at + starts[new], np.diff(np.append(new, len(starts))), _mixed(anchor[new]) & _ANCHOR_BITS
        if count.max(initial=0) > PIECE:
            of, step = _steps(-(-count // PIECE))
            first, count, anchor = first[of] + PIECE * step, np.minimum(PIECE, count[of] - PIECE * step), anchor[of]
        return first, count, anchor

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct anchors, ascending, and how many documents have each (2 stands for more)."""
        # Stretches are in document order, and a stable sort keeps them so within an anchor.
        order = np.argsort(self.anchor, kind="stable")
        anchor, document = self.anchor[order], self.document[order]
        if not len(anchor):
            return anchor, np.zeros(0, np.int64)
        begins = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
        ends = np.append(begins[1:], len(anchor)) - 1
        return anchor[begins], 1 + (document[ends] != document[begins])

    def digests(self, first: np.ndarray, count: np.ndarray) -> np.ndarray:
        """A hash of the bytes of each stretch and their number; ``first`` ascends."""
        out = np.zeros(len(first), dtype=np.uint64)
        data = np.frombuffer(self.data, dtype=np.uint8)
        cuts = np.searchsorted(first, np.arange(0, len(data) + self.chunk, self.chunk))
        for k, (a, b) in enumerate(zip(cuts.tolist(), cuts[1:].tolist(), strict=False)):
            at = k * self.chunk
            sums = _sums(data[at : at + self.chunk + self.window + PIECE])
            begin, end = first[a:b] - at, first[a:b] - at + count[a:b] + (self.window - 1)
            out[a:b] = (sums[end] - sums[begin]) * _powers(_INVERSE, self.chunk)[begin] + count[a:b].astype(np.uint64)
        return _mixed(out)

    def spans(self, first: np.ndarray, last: np.ndarray) -> dict[int, list[tuple[int, int]]]:
        """Bytes under all windows that start from each ``first`` to its ``last``, as runs from each document's start."""
        out: dict[int, list[tuple[int, int]]] = {}
        if not len(first):
            return out
        order = np.argsort(first, kind="stable")
        first, last = first[order], np.maximum.accumulate(last[order])
        document = self.documents(first)
        new = np.flatnonzero(np.concatenate([[True], (first[1:] - last[:-1] > self.window) | (document[1:] != document[:-1])]))
        ends = np.append(new[1:], len(first)) - 1
        begins = np.concatenate([[0], self.ends])
        for k, a, b in zip(document[new].tolist(), first[new].tolist(), last[ends].tolist(), strict=True):
            begin = int(begins[k])
            out.setdefault(k, []).append((a - begin, b + self.window - begin))
        return out


class Stretches:
    """The distinct stretches of a block with shared anchors, by anchor and digest.

    ``example`` is where one of each begins, ``owner`` the smallest id that has
    it; ``of_first`` tells for every place of one (``first``) which it is.
    """

    def __init__(self, block: Block, answers: dict[int, bytes], parts: int):
        values, _ = block.anchors()
        flags = np.concatenate([np.frombuffer(answers[p], np.uint8) for p in np.unique(_parts(values, parts)).tolist()]) if len(values) else np.zeros(0, np.uint8)
        kept = np.flatnonzero(flags[np.searchsorted(values, block.anchor)]) if len(values) else np.zeros(0, np.int64)
        self.block = block
        self.first, self.counts, anchor = block.first[kept], block.count[kept], block.anchor[kept]
        digest = block.digests(self.first, self.counts)
        order = np.lexsort((digest, anchor))
        new = np.ones(len(order), dtype=bool)
        new[1:] = (np.diff(anchor[order]) != 0) | (np.diff(digest[order]) != 0)
        begins = np.flatnonzero(new)
        self.of_first = np.empty(len(order), dtype=np.int64)
        self.of_first[order] = np.cumsum(new) - 1
        chosen = order[begins]
        self.anchor, self.digest, self.example, self.count = anchor[chosen], digest[chosen], self.first[chosen], self.counts[chosen]
        names = sorted(set(block.least.values()))
        place = {name: k for k, name in enumerate(names)}
        rank = np.array([place[owner] for owner in block.least.values()], dtype=np.int64)[block.document[kept]]
        least = np.minimum.reduceat(rank[order], begins) if len(begins) else rank
        self.owner = [names[k] for k in least.tolist()]
        self.behind = rank > least[self.of_first]
        self.part = _parts(self.anchor, parts)

    def by_part(self) -> list[tuple[int, int, int]]:
        """(part, from, to): the partition of anchors that stretches go to."""
        cuts = np.flatnonzero(np.diff(self.part, prepend=np.uint64(0)) != 0)
        cuts = np.unique(np.concatenate([[0], cuts, [len(self.part)]])).tolist()
        return [(int(self.part[a]), a, b) for a, b in zip(cuts, cuts[1:], strict=False)]

    def judged(self, answers: dict[int, bytes]) -> np.ndarray:
        return np.concatenate([np.frombuffer(answers[p], np.uint8) for p, _, _ in self.by_part()] or [np.zeros(0, np.uint8)])

    def asked(self, judged: np.ndarray, parts: int) -> tuple[np.ndarray, ...]:
        """What travels as bytes, by partition: (part, first window, windows, stretch, place in the stretch)."""
        block, window = self.block, self.block.window
        whole, split = np.flatnonzero(judged == WHOLE), np.flatnonzero(judged == SPLIT)
        of, step = _steps(self.count[split])
        begin = self.example[split][of] + step
        own = np.array([xxhash.xxh64_intdigest(block.data[a : a + window]) for a in begin.tolist()], dtype=np.uint64)
        part = np.concatenate([_parts(self.anchor[whole], parts), _parts(own, parts)])
        order = np.argsort(part, kind="stable")
        columns = (
            (part, np.zeros(0, part.dtype)),
            (self.example[whole], begin),
            (self.count[whole], np.ones_like(begin)),
            (whole, split[of]),
            (np.zeros_like(whole), step),
        )
        return tuple(np.concatenate(c)[order] for c in columns)

    def hits(self, judged: np.ndarray, asked: tuple[np.ndarray, ...], bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last of runs of windows that a smaller id has."""
        mask = np.where(judged == REPEATED, np.int64(-1), np.int64(0))
        np.bitwise_or.at(mask, asked[3], bits << asked[4])
        flags = np.where(self.behind, np.int64(-1), mask[self.of_first])
        whole, some = flags == -1, np.flatnonzero((flags != 0) & (flags != -1))
        of, step = _steps(self.counts[some])
        single = (self.first[some][of] + step)[(flags[some][of] >> step & 1) == 1]
        first = self.first[whole]
        return np.concatenate([first, single]), np.concatenate([first + self.counts[whole] - 1, single])


# Replies to a block.
OF_ANCHORS, OF_DIGESTS, OF_BYTES = range(3)
# What is known of a stretch by its digest: no window repeats, all do, or its bytes are wanted, whole or window by window.
UNIQUE, REPEATED, WHOLE, SPLIT = range(4)


def judge(anchors: np.ndarray, digests: np.ndarray, owners: list, spread: int) -> np.ndarray:
    """What is known of each stretch from the digests of all blocks."""
    ranks = {o: k for k, o in enumerate(sorted(set(owners)))}
    rank = np.array([ranks[o] for o in owners], dtype=np.int64)
    order = np.lexsort((rank, digests, anchors))
    rank = rank[order]
    new_anchor = np.ones(len(order), dtype=bool)
    new_anchor[1:] = np.diff(anchors[order]) != 0
    new_text = new_anchor.copy()
    new_text[1:] |= np.diff(digests[order]) != 0
    group = np.cumsum(new_anchor) - 1
    smallest = rank == rank[np.flatnonzero(new_text)][np.cumsum(new_text) - 1]
    wanted = smallest & (np.bincount(group, weights=new_text) > 1)[group]
    split = (np.bincount(group, weights=wanted) > spread)[group]
    out = np.empty(len(order), dtype=np.uint8)
    out[order] = np.where(wanted, np.where(split, SPLIT, WHOLE), np.where(smallest, UNIQUE, REPEATED))
    return out


def _parts(hashes: np.ndarray, parts: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)


def _steps(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For counts (2, 3): which count, 0 0 1 1 1, and how far in it, 0 1 0 1 2."""
    of = np.repeat(np.arange(len(counts)), counts)
    return of, np.arange(len(of)) - np.repeat(np.cumsum(counts) - counts, counts)


def _classes(bodies: list[bytes], starts: np.ndarray, counts: np.ndarray, window: int) -> np.ndarray:
    """Class numbers of all windows of distinct stretches.

    Only stretches with a window whose hash another window has are sorted; no
    window of the rest can have an equal.
    """
    hashes = _hashes(np.frombuffer(b"".join(bodies), dtype=np.uint8), window)[starts]
    _, place, times = np.unique(hashes, return_inverse=True, return_counts=True)
    begins = np.cumsum(counts) - counts
    sorted_ones = np.logical_or.reduceat(times[place] > 1, begins)
    classes = np.arange(len(starts))
    if sorted_ones.any():
        chosen = [b for b, wanted in zip(bodies, sorted_ones.tolist(), strict=True) if wanted]
        sizes = np.array([len(b) for b in chosen], dtype=np.int64)
        of, step = _steps(counts[sorted_ones])
        found = equal_windows(b"".join(chosen), (np.cumsum(sizes) - sizes)[of] + step, window)
        classes[np.repeat(sorted_ones, counts)] = len(starts) + found
    return classes


def smaller_owner(bodies: list[bytes], owners: list, window: int) -> np.ndarray:
    """For each stretch a bit per window: another stretch has it with a smaller id."""
    distinct: dict[bytes, int] = {}
    for body in bodies:
        distinct.setdefault(body, len(distinct))
    ranks = {o: k for k, o in enumerate(sorted(set(owners)))}
    rank = np.array([ranks[o] for o in owners], dtype=np.int64)
    which = np.array([distinct[b] for b in bodies], dtype=np.int64)
    least = np.full(len(distinct), len(ranks), dtype=np.int64)
    np.minimum.at(least, which, rank)
    sizes = np.array([len(b) for b in distinct], dtype=np.int64)
    begins = np.cumsum(sizes) - sizes
    counts = sizes - window + 1
    of, step = _steps(counts)
    starts = begins[of] + step
    classes = _classes(list(distinct), starts, counts, window)
    best = np.full(int(classes.max(initial=-1)) + 1, len(ranks), dtype=np.int64)
    np.minimum.at(best, classes, np.repeat(least, counts))
    offsets = (np.cumsum(counts) - counts)[which]
    of, step = _steps(counts[which])
    smaller = best[classes[offsets[of] + step]] < rank[of]
    return np.add.reduceat(smaller.astype(np.int64) << step, np.flatnonzero(step == 0))


def find_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, gram: int = GRAM, block_bytes: int = BLOCK_BYTES, part_bytes: int = PART_BYTES, sort_bytes: int = SORT_BYTES, spread_blocks: int = SPREAD_BLOCKS, chunk: int = CHUNK) -> DataFrame:
    """Rows (doc_id, n_bytes, removed): the byte spans (start, end) to take out of every document."""
    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    size = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks, parts, sort_parts = (max(1, math.ceil(size / most)) for most in (block_bytes, part_bytes, sort_bytes))
    dealt = source.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("long")).repartition("block")

    def read(table: pa.Table) -> Block:
        return Block(table.column("doc_id").to_pylist(), table.column("text").to_pylist(), window, gram, chunk)

    def anchors(key: tuple, table: pa.Table) -> pa.Table:
        values, counts = read(table).anchors()
        where = _parts(values, parts)
        rows = []
        for p in np.unique(where).tolist():
            mine = where == p
            rows.append((p, packed(values[mine]), planes(counts[mine])))
        part, hashes, found = zip(*rows, strict=True) if rows else ((), (), ())
        return pa.table({"part": pa.array(part, pa.int64()), "block": pa.array([key[0].as_py()] * len(part), pa.int64()), "hashes": pa.array(hashes, pa.binary()), "counts": pa.array(found, pa.binary())})

    def answered(key: tuple, blocks: pa.Table, kind: int, out: list[bytes]) -> pa.Table:
        n = len(out)
        return pa.table({"part": pa.array([key[0].as_py()] * n, pa.int64()), "block": blocks.column("block").combine_chunks(), "kind": pa.array([kind] * n, pa.int32()), "answers": pa.array(out, pa.binary())})

    def cut(answer: np.ndarray, sizes: list[int]) -> list[bytes]:
        return [a.astype(np.uint8).tobytes() for a in np.split(answer, np.cumsum(sizes)[:-1])]

    def compare(key: tuple, table: pa.Table) -> pa.Table:
        arrays = [unpacked(h) for h in table.column("hashes").to_pylist()]
        counts = np.concatenate([from_planes(c) for c in table.column("counts").to_pylist()])
        _, place = np.unique(np.concatenate(arrays), return_inverse=True)
        answer = np.bincount(place, weights=counts)[place] > 1
        return answered(key, table, OF_ANCHORS, cut(answer, [len(a) for a in arrays]))

    def replies_of(table: pa.Table, kind: int) -> dict[int, bytes]:
        mine = table.filter(pc.equal(table.column("kind"), kind))
        return dict(zip(mine.column("part").to_pylist(), mine.column("answers").to_pylist(), strict=True))

    def stretches(left: pa.Table, right: pa.Table) -> Stretches:
        return Stretches(read(left), replies_of(right, OF_ANCHORS), parts)

    id_field = source.schema["doc_id"]

    def tell(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        found = stretches(left, right)
        rows = found.by_part()
        return pa.table({
            "part": pa.array([p for p, _, _ in rows], pa.int64()),
            "block": pa.array([key[0].as_py()] * len(rows), pa.int64()),
            "anchors": pa.array([packed(found.anchor[a:b]) for _, a, b in rows], pa.binary()),
            "digests": pa.array([found.digest[a:b].astype("<u8").tobytes() for _, a, b in rows], pa.binary()),
            "owners": pa.array([found.owner[a:b] for _, a, b in rows], pa.list_(left.schema.field("doc_id").type)),
        })

    def weigh(key: tuple, table: pa.Table) -> pa.Table:
        arrays = [unpacked(h) for h in table.column("anchors").to_pylist()]
        digests = np.frombuffer(b"".join(table.column("digests").to_pylist()), dtype="<u8")
        owners = table.column("owners").combine_chunks().flatten().to_pylist()
        return answered(key, table, OF_DIGESTS, cut(judge(np.concatenate(arrays), digests, owners, spread_blocks), [len(a) for a in arrays]))

    def send(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        found = stretches(left, right)
        part, first, count, which, _ = found.asked(found.judged(replies_of(right, OF_DIGESTS)), sort_parts)
        squeeze = zstandard.ZstdCompressor(level=3).compress
        data, sizes = found.block.data, count + window - 1
        cuts = np.unique(np.concatenate([[0], 1 + np.flatnonzero(np.diff(part) != 0), [len(part)]])).tolist()
        runs = list(zip(cuts, cuts[1:], strict=False))
        return pa.table({
            "part": pa.array([int(part[a]) for a, _ in runs], pa.int64()),
            "block": pa.array([key[0].as_py()] * len(runs), pa.int64()),
            "sizes": pa.array([sizes[a:b].astype("<u2").tobytes() for a, b in runs], pa.binary()),
            "bodies": pa.array([squeeze(b"".join([data[i : i + n] for i, n in zip(first[a:b].tolist(), sizes[a:b].tolist(), strict=True)])) for a, b in runs], pa.binary()),
            "owners": pa.array([[found.owner[k] for k in which[a:b].tolist()] for a, b in runs], pa.list_(left.schema.field("doc_id").type)),
        })

    def sort(key: tuple, table: pa.Table) -> pa.Table:
        bodies, owners, cuts = [], [], [0]
        unsqueeze = zstandard.ZstdDecompressor().decompress
        for sizes, data, ids in zip(table.column("sizes").to_pylist(), table.column("bodies").to_pylist(), table.column("owners").to_pylist(), strict=True):
            at, data = 0, unsqueeze(data)
            for n in np.frombuffer(sizes, "<u2").tolist():
                bodies.append(data[at : at + n])
                at += n
            owners += ids
            cuts.append(len(bodies))
        bits = smaller_owner(bodies, owners, window)
        return answered(key, table, OF_BYTES, [planes(bits[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)])

    def mark(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        found = stretches(left, right)
        block = found.block
        judged = found.judged(replies_of(right, OF_DIGESTS))
        sorted_bits = replies_of(right, OF_BYTES)
        bits = np.concatenate([from_planes(sorted_bits[p]) for p in sorted(sorted_bits)] or [np.zeros(0, np.int64)])
        gone = block.spans(*found.hits(judged, found.asked(judged, sort_parts), bits))
        removed, sizes, digests = [], [], []
        for owner, body in block.rows:
            spans: list[tuple[int, int]] = []
            if owner is not None and len(body) >= window:
                spans = [(0, len(body))] if owner > block.least[body] else gone.get(block.number[body], [])
            kept, at = [], 0
            for a, b in spans:
                kept.append(body[at:a])
                at = b
            kept.append(body[at:])
            removed.append([{"start": a, "end": b} for a, b in spans])
            sizes.append(len(body))
            digests.append(hashlib.sha256(b"".join(kept)).hexdigest())
        return pa.table({"doc_id": left.column("doc_id").combine_chunks(), "n_bytes": pa.array(sizes, pa.int64()), "removed": pa.array(removed, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), "kept_sha256": pa.array(digests, pa.string())})

    by_block = dealt.groupBy("block")
    reply = "part long, block long, kind int, answers binary"
    told = by_block.applyInArrow(anchors, "part long, block long, hashes binary, counts binary")
    answers = told.groupBy("part").applyInArrow(compare, reply)
    long, binary, ids = T.LongType(), T.BinaryType(), T.ArrayType(id_field.dataType)
    told_schema = T.StructType([T.StructField("part", long), T.StructField("block", long), T.StructField("anchors", binary), T.StructField("digests", binary), T.StructField("owners", ids)])
    weighed = by_block.cogroup(answers.groupBy("block")).applyInArrow(tell, told_schema).groupBy("part").applyInArrow(weigh, reply)
    known = answers.unionAll(weighed)
    sent_schema = T.StructType([T.StructField("part", long), T.StructField("block", long), T.StructField("sizes", binary), T.StructField("bodies", binary), T.StructField("owners", ids)])
    sent = by_block.cogroup(known.groupBy("block")).applyInArrow(send, sent_schema)
    bits = sent.groupBy("part").applyInArrow(sort, reply)
    span = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    schema = T.StructType([id_field, T.StructField("n_bytes", T.LongType()), T.StructField("removed", span), T.StructField("kept_sha256", T.StringType())])
    return by_block.cogroup(known.unionAll(bits).groupBy("block")).applyInArrow(mark, schema)


def repeat_report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Counts of removed bytes and spans and a digest of what is kept, for every document."""
    found = find_repeats(docs, doc_id, text)
    n_removed = F.aggregate("removed", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select("doc_id", "n_bytes", n_removed.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), "kept_sha256")
