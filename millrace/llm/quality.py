"""Quality rules as a short-circuit cascade, in DataFrame functions only.

Every rule is a predicate over lazily computed measures of a text. A bounded
sample tells how long each rule takes and what share it rejects; rules then run
in the order of rejections per second, and a text that one rule rejects is not
measured for the rest. The order changes the work, never the verdict.

Defined results: a null or empty text has no words, all counts are 0 and it is
rejected as too short; repeated rows are judged each on its own; an empty table
gives an empty table; columns other than the text pass through untouched, and
names that would clash with added ones are replaced by the added ones.
"""

from __future__ import annotations

import time
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.arrays import let
from millrace.session import settle

WORD = r"[^\x20\x09-\x0D]+"
WINDOW = 5
# Rows looked at to estimate cost and selectivity.
SAMPLE_ROWS = 2000


def _whole(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(_whole(text), F.lit(WORD), F.lit(0))


def word_count(text: Column) -> Column:
    return F.size(words_of(text)).cast("long")


def word_characters(text: Column) -> Column:
    return F.length(F.regexp_replace(_whole(text), r"[\x20\x09-\x0D]+", "")).cast("long")


def symbol_count(text: Column) -> Column:
    return F.length(F.regexp_replace(_whole(text), r"[^#*$%&|<>]+", "")).cast("long")


def letter_count(text: Column) -> Column:
    return F.length(F.regexp_replace(_whole(text), r"\P{L}+", "")).cast("long")


def wordy_lines(text: Column) -> Column:
    """The lines that hold at least one word."""
    return F.filter(F.split(_whole(text), "\n", -1), lambda line: F.rlike(line, F.lit(r"[^\x20\x09-\x0D]")))


def duplicate_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line of the text."""
    return let(wordy_lines(text), lambda lines: (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"))


def _marked(hashes: Column) -> Column:
    """Words under windows whose hash comes up at least twice."""

    def repeated(tagged: Column) -> Column:
        def twin(item: Column, i: Column) -> Column:
            before = F.get(tagged, i - 1).getField("hash")
            after = F.get(tagged, i + 1).getField("hash")
            return F.coalesce(before == item.getField("hash"), F.lit(False)) | F.coalesce(after == item.getField("hash"), F.lit(False))

        return F.sort_array(F.transform(F.filter(tagged, twin), lambda item: item.getField("at")))

    def covered(starts: Column) -> Column:
        steps = F.transform(starts, lambda at, i: F.coalesce(F.least(at - F.get(starts, i - 1), F.lit(WINDOW)), F.lit(WINDOW)))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda total, step: total + step)

    tagged = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("hash"), i.alias("at"))))
    return let(tagged, lambda bound: let(repeated(bound), covered))


def repeated_words(words: Column) -> Column:
    """Words inside five-word windows that come up twice or more in the text, the first included."""

    def windows(bound: Column) -> Column:
        last = F.size(bound) - WINDOW
        return F.transform(
            F.sequence(F.lit(0), F.greatest(last, F.lit(0))),
            lambda i: F.xxhash64(*[F.get(bound, i + k) for k in range(WINDOW)]),
        )

    def counted(hashes: Column) -> Column:
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(_marked(hashes))

    return let(words, lambda bound: F.when(F.size(bound) < WINDOW, F.lit(0).cast("long")).otherwise(let(windows(bound), counted)))


@dataclass(frozen=True)
class Rule:
    """A predicate that rejects, over measures named as keys of ``MEASURES``."""

    name: str
    rejects: object


MEASURES = {
    "n_words": word_count,
    "word_chars": word_characters,
    "n_symbols": symbol_count,
    "n_letters": letter_count,
    "n_lines": lambda text: F.size(wordy_lines(text)).cast("long"),
    "n_dup_lines": duplicate_lines,
    "n_repeat_words": lambda text: repeated_words(words_of(text)),
}

# Limits in the manner of published web-corpus filters.
TOO_SHORT = Rule("too_short", lambda m: m("n_words") < 10)
REPETITIVE = Rule("repetitive", lambda m: 100 * m("n_repeat_words") > 20 * m("n_words"))
BASE_RULES = (TOO_SHORT, REPETITIVE)
RULES = (
    *BASE_RULES,
    Rule("symbols", lambda m: 10 * m("n_symbols") > m("n_words")),
    Rule("word_length", lambda m: (2 * m("word_chars") < 5 * m("n_words")) | (m("word_chars") > 12 * m("n_words"))),
    Rule("few_letters", lambda m: 2 * m("n_letters") < m("word_chars")),
    Rule("duplicate_lines", lambda m: 2 * m("n_dup_lines") > m("n_lines")),
)


@dataclass(frozen=True)
class Profile:
    """What the sample says about one rule."""

    rule: Rule
    seconds: float
    rejected: float

    @property
    def yield_per_second(self) -> float:
        return self.rejected / max(self.seconds, 1e-6)


def measured(text: Column):
    """A lookup that computes a measure of ``text`` where it is used."""
    return lambda name: MEASURES[name](text)


def profile_rules(docs: DataFrame, text: str = "text", rules: Sequence[Rule] = RULES, sample_rows: int = SAMPLE_ROWS, seed: int = 7) -> list[Profile]:
    """Time every rule on one written sample, and count what it rejects.

    The sample is a seeded draw of about ``sample_rows`` rows whatever the
    table's size; it decides the order of the rules only. The time of a rule
    that does nothing is taken off as the cost of starting a job.
    """
    total = docs.count()
    if not total:
        return [Profile(rule, 1.0, 0.0) for rule in rules]
    sample = settle(docs.select(F.col(text).alias("text")).sample(min(1.0, sample_rows / total), seed), "quality-sample")

    def timed(predicate: Column) -> tuple[float, float]:
        started = time.perf_counter()
        hits, rows = sample.agg(F.count_if(predicate), F.count(F.lit(1))).first()
        return time.perf_counter() - started, hits / rows if rows else 0.0

    timed(F.length("text") < 0)
    idle = timed(F.length("text") < 0)[0]
    look = measured(F.col("text"))
    profiles = []
    for rule in rules:
        seconds, share = timed(rule.rejects(look))
        profiles.append(Profile(rule, max(seconds - idle, 1e-3), share))
    return profiles


def ordered_rules(profiles: Sequence[Profile]) -> list[Rule]:
    """Most rejections per second first; equal yields keep their given order."""
    return [p.rule for p in sorted(profiles, key=lambda p: -p.yield_per_second)]


def verdict(rules: Sequence[Rule], look) -> Column:
    """Name of the first rule that rejects, null for a text that all rules keep.

    CASE evaluates its branches in turn, so later measures are only computed
    for texts that earlier rules keep.
    """
    chain = None
    for rule in rules:
        rejected = rule.rejects(look)
        chain = F.when(rejected, rule.name) if chain is None else chain.when(rejected, rule.name)
    return chain.otherwise(F.lit(None).cast("string")) if chain is not None else F.lit(None).cast("string")


def judge(docs: DataFrame, text: str = "text", rules: Sequence[Rule] = RULES) -> DataFrame:
    """Add ``rejected_by``: the rule that turned the text down, or null."""
    order = ordered_rules(profile_rules(docs, text, rules))
    return docs.withColumn("rejected_by", verdict(order, measured(F.col(text))))


def keep_good(docs: DataFrame, text: str = "text", rules: Sequence[Rule] = RULES) -> DataFrame:
    """The documents that no rule rejects, unchanged."""
    order = ordered_rules(profile_rules(docs, text, rules))
    return docs.where(verdict(order, measured(F.col(text))).isNull())


def quality_report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """All measures of every text, the fixed base verdict and the cascade's."""
    order = ordered_rules(profile_rules(docs, text))
    worded = docs.select(F.col(doc_id).alias("doc_id"), _whole(F.col(text)).alias("text"), words_of(F.col(text)).alias("words"))
    lines = let(wordy_lines(F.col("text")), lambda x: F.struct(F.size(x).cast("long").alias("all"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup")))
    table = worded.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        word_characters(F.col("text")).alias("word_chars"),
        symbol_count(F.col("text")).alias("n_symbols"),
        letter_count(F.col("text")).alias("n_letters"),
        lines.alias("lines"),
        repeated_words(F.col("words")).alias("n_repeat_words"),
    ).withColumns({"n_lines": F.col("lines.all"), "n_dup_lines": F.col("lines.dup")})
    base_failed = F.lit(False)
    for rule in BASE_RULES:
        base_failed = base_failed | rule.rejects(F.col)
    return table.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base_failed.alias("base_failed"),
        verdict(order, F.col).alias("rejected_by"),
    ).withColumn("kept", ~F.col("base_failed") & F.col("rejected_by").isNull())
