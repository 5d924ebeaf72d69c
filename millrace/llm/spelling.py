"""Spelling variants through a dictionary of pairs of trie nodes.

Words one edit apart agree before and after one place. All words are put into
a trie, and reversed into another; every prefix and every suffix is then one
integer, its node. For a word of length L:

* skipping the letter at i leaves the pair (node of the first i letters, node of
  the last L - i - 1): words with an equal skipping pair differ by a replaced
  letter at i;
* the gap at i is the pair (node of the first i letters, node of the last L - i):
  a word whose gap pair equals another's skipping pair lacks that one letter.

So one join of integer pairs finds the exact neighbours, without comparing
words. A pair says all of a word but one letter, so it has at most as many
skipping words as there are letters and one gap word: no pair is ever hot. Two
words that differ by one of several equal letters in a row would meet once for
each; only the last of such letters counts.

A trie is numbered where its words stand in order. Words are dealt to ranges of
some ``RANGE_WORDS`` by sorting; a range numbers the nodes that its words open,
and takes those of the prefix its first word shares with the range before from
that. What passes between ranges is their first and last word.

Within a pair every word takes the commonest other one, so no list of pairs is
written: neighbour counts add up, and the best is a maximum.

Defined results: null and empty texts have no words; equal rows count each; a
null id reads as an empty one; an empty table gives an empty table; only the
named columns are read, so clashing names do not matter. Words of any length
are whole; nothing is sampled or capped.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.session import settle

LETTERS = "A-Za-zÀ-ÿ"
LEAST_LETTERS = 5
LEAST_OCCURRENCES = 3
# A form is at least so many times as common as its variant.
FORM_FACTOR = 2
# One in so many words of a document loses a letter.
LOSSY_ONE_IN = 97
# Distinct words that a task counts before it sends them on.
COUNTED_TOGETHER = 400_000
RANGE_WORDS = 200_000
# Ways in which the variants of one root are split.
SALTS = 16
ROOT = 0
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def document_words(doc_id, text: str | None, least: int, lossy_one_in: int | None) -> Counter:
    """How often each word of at least ``least`` letters occurs in a document, after letters got lost."""
    found: Counter = Counter()
    for word, n in Counter(re.findall(f"[{LETTERS}]{{{least},}}", text or "")).items():
        found[word.lower() if word.isascii() else word.translate(_LOWER)] += n
    if not lossy_one_in:
        return found
    start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    words: Counter = Counter()
    for word, n in found.items():
        draw = zlib.crc32(word.encode(), start)
        if draw % lossy_one_in == 0:
            at = draw % len(word)
            word = word[:at] + word[at + 1 :]
            if len(word) < least:
                continue
        words[word] += n
    return words


def word_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = LEAST_LETTERS, occurrences: int = LEAST_OCCURRENCES, lossy_one_in: int | None = LOSSY_ONE_IN) -> DataFrame:
    """Rows (word, n) of the words that occur often enough."""

    def table(counts: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], names=["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for identity, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for word, n in document_words(identity, body, least, lossy_one_in).items():
                    counts[word] += n
                if len(counts) > COUNTED_TOGETHER:
                    yield table(counts)
                    counts = Counter()
        yield table(counts)

    parts = docs.select(F.col(doc_id), F.col(text).cast("string")).mapInArrow(run, "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= occurrences)


def shared_prefix(one: str, other: str) -> int:
    n = 0
    for a, b in zip(one, other, strict=False):
        if a != b:
            break
        n += 1
    return n


def number_nodes(words: list[str], first_number: int, start: list[int]) -> list[list[int]]:
    """For ascending words their nodes from the root on; ``start`` has the nodes that the first word shares with words before."""
    out = []
    before, nodes, number = "", [ROOT], first_number
    for word in words:
        shared = shared_prefix(before, word)
        fresh = len(word) - shared
        nodes = nodes[: shared + 1] + list(range(number, number + fresh))
        number += fresh
        if not out:
            # Numbers are given out as if nothing came before, so they do not depend on the range before.
            nodes[: len(start)] = start
        out.append(nodes)
        before = word
    return out


def _first_number(part: int) -> int:
    return (part << 36) + 1


def with_nodes(words: DataFrame, key: str, name: str, range_words: int = RANGE_WORDS) -> DataFrame:
    """Add the trie nodes of the strings of ``key``, which are distinct: one for each prefix, the empty one first."""
    ranges = max(1, math.ceil(words.count() / range_words))
    dealt = settle(words.repartitionByRange(ranges, key).withColumn("part", F.spark_partition_id()), "trie-ranges")

    def ends(table: pa.Table) -> pa.Table:
        ordered = sorted(table.column(key).to_pylist())
        part = table.column("part")[0].as_py()
        nodes = number_nodes(ordered, _first_number(part), [ROOT])
        return pa.table({"part": pa.array([part], pa.int32()), "first": [ordered[0]], "last": [ordered[-1]], "nodes": pa.array([nodes[-1]], pa.list_(pa.int64()))})

    # One row for each range of words.
    edges = dealt.select(key, "part").groupBy("part").applyInArrow(ends, "part int, first string, last string, nodes array<long>").orderBy("part").collect()
    starts: dict[int, list[int]] = {}
    before, nodes = "", [ROOT]
    for edge in edges:
        starts[edge.part] = start = nodes[: shared_prefix(before, edge.first) + 1]
        kept = min(len(start), shared_prefix(edge.first, edge.last) + 1)
        before, nodes = edge.last, start[:kept] + edge.nodes[kept:]
    known = words.sparkSession.sparkContext.broadcast(starts)
    schema = T.StructType([*words.schema.fields, T.StructField(name, T.ArrayType(T.LongType()))])

    def number(table: pa.Table) -> pa.Table:
        table = table.sort_by(key)
        part = table.column("part")[0].as_py()
        nodes = number_nodes(table.column(key).to_pylist(), _first_number(part), known.value[part])
        return table.drop_columns("part").append_column(name, pa.array(nodes, pa.list_(pa.int64())))

    return dealt.groupBy("part").applyInArrow(number, schema)


def dictionary(counts: DataFrame, range_words: int = RANGE_WORDS) -> DataFrame:
    """Rows (word, n, forward, backward, number, letters); numbers ascend like words by code point."""
    forward = settle(with_nodes(counts, "word", "forward", range_words).withColumn("turned", F.reverse("word")), "trie-forward")
    both = with_nodes(forward, "turned", "backward", range_words).drop("turned")
    return settle(both.select("word", "n", "forward", "backward", F.element_at("forward", -1).alias("number"), F.split("word", "").alias("letters")), "dictionary")


# What a posting is: a skipped letter that is followed by an equal one, another skipped letter, or a gap.
DOUBLED, SKIPPED, GAP = 0, 1, 2


def postings(words: DataFrame) -> DataFrame:
    """Rows (prefix, suffix, kind, n, number), one for each letter to skip and each gap of a word."""
    length = F.size("forward") - 1
    forward, backward = F.col("forward"), F.col("backward")

    def skipped(i):
        doubled = F.get("letters", i) == F.get("letters", i + 1)
        return F.struct(F.get(forward, i).alias("prefix"), F.get(backward, length - i - 1).alias("suffix"), F.when(doubled, DOUBLED).otherwise(SKIPPED).alias("kind"))

    def gap(i):
        return F.struct(F.get(forward, i).alias("prefix"), F.get(backward, length - i).alias("suffix"), F.lit(GAP).alias("kind"))

    pairs = F.concat(F.transform(F.sequence(F.lit(0), length - 1), skipped), F.transform(F.sequence(F.lit(0), length), gap))
    return words.select(F.explode(pairs).alias("pair"), "n", "number").select("pair.prefix", "pair.suffix", "pair.kind", "n", "number")


def near_in_pairs(prefix: np.ndarray, suffix: np.ndarray, kind: np.ndarray, n: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, ...]:
    """For rows ordered by pair and, within one, by falling n and rising number: (number, near words, n of the best, the best)."""
    new = np.concatenate(([True], (prefix[1:] != prefix[:-1]) | (suffix[1:] != suffix[:-1])))
    pair = np.cumsum(new) - 1
    held = np.bincount(pair) > 1
    keep = held[pair]
    kind, n, number, pair = kind[keep], n[keep], number[keep], np.cumsum(held)[pair[keep]] - 1
    pairs = int(held.sum())
    skip, single, gap = kind != GAP, kind == SKIPPED, kind == GAP

    def nth(rows: np.ndarray, which: int) -> np.ndarray:
        """The place of the first or second of some rows of each pair, -1 without one."""
        places = np.flatnonzero(rows)
        of = pair[places]
        rank = np.arange(len(of)) - np.searchsorted(of, of)
        out = np.full(pairs, -1)
        out[of[rank == which]] = places[rank == which]
        return out

    def chosen(places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.where(places >= 0, n[places], 0), np.where(places >= 0, number[places], 0)

    skips, singles = np.bincount(pair[skip], minlength=pairs), np.bincount(pair[single], minlength=pairs)
    best, second, best_single, the_gap = nth(skip, 0), nth(skip, 1), nth(single, 0), nth(gap, 0)
    here = np.arange(len(pair))
    # Other words with the letter replaced, and the word that lacks it; for that word, those with the letter.
    replaced = np.where(best[pair] == here, second[pair], best[pair])
    lacking = np.where(single, the_gap[pair], -1)
    first = np.where(gap, best_single[pair], replaced)
    near = np.where(gap, singles[pair], skips[pair] - 1 + (lacking >= 0))
    first_n, first_number = chosen(first)
    lacking_n, lacking_number = chosen(lacking)
    better = (lacking_n > first_n) | ((lacking_n == first_n) & (lacking_number < first_number))
    met = near > 0
    return number[met], near[met], np.where(better, lacking_n, first_n)[met], np.where(better, lacking_number, first_number)[met]


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    waiting = [np.zeros(0, dtype=np.int64)] * 5

    def found(columns: list[np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in near_in_pairs(*columns)], names=["number", "near", "best_n", "best"])

    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [np.concatenate([w, c.to_numpy(zero_copy_only=False).astype(np.int64)]) for w, c in zip(waiting, batch.columns, strict=True)]
        # The last pair may go on in the next batch.
        other = np.flatnonzero((columns[0] != columns[0][-1]) | (columns[1] != columns[1][-1]))
        cut = int(other[-1]) + 1 if len(other) else 0
        if cut:
            yield found([c[:cut] for c in columns])
        waiting = [c[cut:] for c in columns]
    if len(waiting[0]):
        yield found(waiting)


def neighbours(words: DataFrame) -> DataFrame:
    """Rows (number, n_near, best_n, best) of the words that have near ones; the best is the commonest, then the first."""
    ordered = postings(words).repartition("prefix", "suffix").sortWithinPartitions("prefix", "suffix", F.desc("n"), "number")
    met = ordered.mapInArrow(_neighbours, "number long, near long, best_n long, best long")
    best = F.max(F.struct("best_n", (-F.col("best")).alias("back")))
    return met.groupBy("number").agg(F.sum("near").alias("n_near"), best.alias("top")).select("number", "n_near", F.col("top.best_n").alias("best_n"), (-F.col("top.back")).alias("best"))


def last_forms(links: DataFrame) -> DataFrame:
    """Rows (number, root) for links (number, form), which never form a circle.

    Every round doubles how far a link reaches, and only links whose form goes
    on take part. Forms are at least twice as common as their variants, so
    there are at most as many rounds as the bits of a logarithm of a count.
    """
    onward = links.select(F.col("number").alias("form"), F.col("form").alias("next"))
    # A word has few near ones, so few variants name it as their form.
    step = settle(links.join(onward, "form", "left").select("number", "form", F.col("next").isNotNull().alias("open")), "forms")
    done = [step.where(~F.col("open"))]
    step = step.where("open")
    reach = settle(done[0].unionAll(step), "form-reach")
    while not step.isEmpty():
        ahead = reach.select(F.col("number").alias("form"), F.col("form").alias("next"), F.col("open").alias("more"))
        moved = settle(step.join(ahead, "form").select("number", F.col("next").alias("form"), F.col("more").alias("open")), "forms")
        reach = settle(reach.where(~F.col("open")).unionAll(moved), "form-reach")
        step = reach.where("open")
    return reach.select("number", F.col("form").alias("root"))


def spelling_groups(counts: DataFrame, factor: int = FORM_FACTOR, range_words: int = RANGE_WORDS) -> DataFrame:
    """Rows (word, form, root, n, n_near, form_n) for rows (word, n) of distinct words."""
    words = dictionary(counts, range_words)
    near = settle(words.select("number", "word", "n").join(neighbours(words), "number", "left"), "near-words")
    has_form = F.col("best_n") >= factor * F.col("n")
    roots = last_forms(settle(near.where(has_form).select("number", F.col("best").alias("form")), "form-links"))
    names = near.select(F.col("number").alias("best"), F.col("word").alias("form"), F.col("n").alias("form_n"))
    formed = near.where(has_form).select("number", "best").join(names, "best").join(roots, "number").select("number", "form", "form_n", "root")
    # A root may stand for very many words, so its name is looked up under several salts.
    salted = formed.withColumn("salt", F.pmod("number", F.lit(SALTS)).cast("int"))
    of_roots = roots.select("root").distinct().join(near.select(F.col("number").alias("root"), F.col("word").alias("root_word")), "root")
    of_roots = of_roots.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    named = salted.join(of_roots, ["root", "salt"]).select("number", "form", "form_n", "root_word")
    whole = near.select("number", "word", "n", "n_near").join(named, "number", "left")
    return whole.select("word", "form", F.coalesce("root_word", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), "form_n")


def variant_report(docs: DataFrame) -> DataFrame:
    """Spelling groups of the words of all documents."""
    return spelling_groups(settle(word_counts(docs), "word-counts"))
