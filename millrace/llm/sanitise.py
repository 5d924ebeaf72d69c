"""Information-theoretic sanitisation of personal data, in DataFrame functions only.

Entities (mail and IP addresses, card and phone numbers) are found by pattern.
Other terms may give them away: the corpus says how strongly. With lines as
contexts, a term t discloses an entity e by

    PMI(t; e) / IC(e) = log(n(t, e) * N / (n(t) * n(e))) / log(N / n(e)),

which is 1 if t never stands in a line without e, and 0 if they are
independent. In the lines where e stands, terms at or above ``remove_at`` are
removed and terms at or above ``generalise_at`` are replaced by their class.
A pair must come up in ``min_contexts`` different lines to count, so copies of
one line are no evidence. Counts cover every line of the corpus.

Defined results: null and empty texts have no spans; equal rows get equal
spans; null ids are kept; an empty table gives an empty table; other columns
stay. ``find_spans`` replaces a column named pii_spans; ``sanitise`` keeps it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.arrays import let
from millrace.llm.text import fresh_name, sheltered
from millrace.session import settle

GENERALISE_AT = 0.9
REMOVE_AT = 1.0
MIN_CONTEXTS = 2
TERM = r"[\p{L}\p{N}]+"

# Patterns of the four kinds, in their order. Repeats are possessive where
# nothing that follows could need a step back, so long runs need no stack.
KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# Texts without these have none of the kind.
HINTS = {"email": r"@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){13}", "phone": r"\+[0-9]"}
# Matches or spans that are put together at once.
STEP = 128
_BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])"
LABELS = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]"}
_FOUND = "array<struct<start:int,end:int,value:string>>"
SPANS = "array<struct<start:int,rank:int,end:int,kind:string,value:string>>"


def located(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches as (start, end, value), in code points.

    Matches are placed within blocks of ``STEP`` and the blocks then moved, so
    the work grows with the number of matches and not with its square.
    """

    def placed(pieces: Column, matches: Column) -> Column:
        def add(state: Column, i: Column) -> Column:
            match = F.get(matches, i)
            start = state["at"] + F.length(F.get(pieces, i))
            end = start + F.length(match)
            found = F.struct(start.alias("start"), end.alias("end"), match.alias("value"))
            return F.struct(end.alias("at"), F.concat(state["found"], F.array(found)).cast(_FOUND).alias("found"))

        def block(b: Column) -> Column:
            nothing = F.struct(F.lit(0).alias("at"), F.array().cast(_FOUND).alias("found"))
            return F.aggregate(F.sequence(b * STEP, F.least(F.size(matches), (b + 1) * STEP) - 1), nothing, add)

        def moved(blocks: Column) -> Column:
            def pushed(found: Column, by: Column) -> Column:
                return F.transform(found, lambda m: F.struct((m["start"] + by).alias("start"), (m["end"] + by).alias("end"), m["value"].alias("value")))

            begins = F.aggregate(
                blocks, F.array(F.lit(0)).cast("array<int>"), lambda sums, x: F.concat(sums, F.array(F.element_at(sums, -1) + x["at"])).cast("array<int>")
            )
            return let(begins, lambda begin: F.flatten(F.transform(blocks, lambda x, b: pushed(x["found"], F.get(begin, b)))))

        several = let(F.transform(F.sequence(F.lit(0), ((F.size(matches) - 1) / STEP).cast("int")), block), moved)
        return F.when(F.size(matches) <= STEP, block(F.lit(0))["found"]).otherwise(several).cast(_FOUND)

    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return let(
        matches,
        lambda m: F.when(F.size(m) == 0, F.array().cast(_FOUND)).otherwise(let(F.split(text, pattern, -1), lambda p: placed(p, m))),
    )


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]+", "")


def _luhn(digits: Column) -> Column:
    def weighed(digit: Column, i: Column) -> Column:
        number = digit.cast("int") * (1 + i % 2)
        return number - F.when(number > 9, 9).otherwise(0)

    return F.aggregate(F.transform(F.split(F.reverse(digits), ""), weighed), F.lit(0), lambda total, v: total + v) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return F.rlike(value, F.lit(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$"))
    if kind == "card":
        return F.when(F.length(_digits(value)).between(14, 19), _luhn(_digits(value))).otherwise(False)
    if kind == "phone":
        return F.length(_digits(value)).between(10, 15)
    return F.lit(True)


def entity_spans(text: Column) -> Column:
    """Spans of all kinds, by start and then kind."""

    def of(kind: str, rank: int) -> Column:
        kept = F.filter(located(text, PATTERNS[kind]), lambda m: _valid(kind, m["value"]))
        spans = F.transform(
            kept, lambda m: F.struct(m["start"].alias("start"), F.lit(rank).alias("rank"), m["end"].alias("end"), F.lit(kind).alias("kind"), m["value"].alias("value"))
        )
        return F.when(F.rlike(text, F.lit(HINTS[kind])), spans.cast(SPANS)).otherwise(F.array().cast(SPANS))

    return F.sort_array(F.concat(*[of(kind, rank) for rank, kind in enumerate(KINDS)]))


def _entity(span: Column) -> Column:
    """The value that the spans of one entity share."""
    return F.concat(span["kind"], F.lit(":"), F.when(span["kind"].isin("card", "phone"), _digits(span["value"])).otherwise(F.lower(span["value"])))


def _mentions(scanned: DataFrame, min_contexts: int) -> tuple[DataFrame, DataFrame]:
    """Rows (row, line, line_hash, entity, term), terms that share a line with an entity, and (row, line, term, start, end), where they stand.

    Entities with fewer than ``min_contexts`` different lines have no pair that
    counts and are left out before terms are sought.
    """
    # No span crosses a line, so the spans of a line are found in the line alone.
    lines = scanned.where(F.size("spans") > 0).select("row", F.explode(located(F.col("text"), r"[^\n]+")).alias("held"))
    lines = lines.where(F.rlike("held.value", F.lit("|".join(HINTS.values()))))
    lines = lines.select("row", F.col("held.start").alias("line"), F.col("held.value").alias("words"), entity_spans(F.col("held.value")).alias("spans"))
    lines = lines.where(F.size("spans") > 0).withColumn("line_hash", F.xxhash64("words"))
    lines = settle(lines.withColumn("entities", F.array_distinct(F.transform("spans", _entity))), "entity-lines")
    each = lines.select("row", "line", "line_hash", F.explode("entities").alias("entity"))
    known = settle(each.groupBy("entity").agg(F.countDistinct("line_hash").alias("n")).where(F.col("n") >= min_contexts).select("entity"), "known-entities")
    # One item for each entity of a line.
    kept = each.join(known, "entity").groupBy("row", "line").agg(F.collect_list("entity").alias("entities"))
    # The terms of a line are found once, whatever number of entities it has, and paired once, however often they stand there.
    terms = lines.drop("entities").join(kept.select("row", "line"), ["row", "line"]).select("row", "line", "spans", F.explode(located(F.col("words"), TERM)).alias("t"))
    outside = terms.where(~F.exists("spans", lambda s: (s["start"] < F.col("t.end")) & (F.col("t.start") < s["end"])))
    places = settle(
        outside.select("row", "line", F.lower("t.value").alias("term"), (F.col("line") + F.col("t.start")).alias("start"), (F.col("line") + F.col("t.end")).alias("end")),
        "term-places",
    )
    owners = lines.select("row", "line", "line_hash").join(kept, ["row", "line"])
    pairs = places.select("row", "line", "term").distinct().join(owners, ["row", "line"])
    return settle(pairs.select("row", "line", "line_hash", F.explode("entities").alias("entity"), "term"), "mentions"), places


def corpus_lines(docs: DataFrame, text: str) -> DataFrame:
    """Every line with a term, as the terms it holds."""
    lines = docs.select(F.explode(F.split(F.lower(F.col(text)), "\n", -1)).alias("line"))
    terms = lines.select(F.array_distinct(F.regexp_extract_all("line", F.lit(TERM), F.lit(0))).alias("terms"))
    return terms.where(F.size("terms") > 0)


def disclosing_terms(docs: DataFrame, text: str, mentions: DataFrame, min_contexts: int = MIN_CONTEXTS, generalise_at: float = GENERALISE_AT) -> DataFrame:
    """Rows (term, entity, disclosure) at or above the lower threshold."""
    place = F.struct("row", "line")
    pairs = mentions.groupBy("term", "entity").agg(F.countDistinct(place).alias("n_both"), F.countDistinct("line_hash").alias("contexts"))
    pairs = settle(pairs.where(F.col("contexts") >= min_contexts), "term-entity-pairs")
    entities = mentions.groupBy("entity").agg(F.countDistinct(place).alias("n_entity"))
    counts = corpus_lines(docs, text).select(F.explode(F.concat(F.array(F.lit("")), F.col("terms"))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n_term"))
    # The empty term counts the lines themselves.
    wanted = pairs.select("term").unionAll(docs.sparkSession.range(1).select(F.lit("").alias("term"))).distinct()
    counts = settle(counts.join(wanted, "term"), "term-counts")
    total = counts.where(F.col("term") == "").agg(F.coalesce(F.max("n_term"), F.lit(0))).first()[0]
    ratio = F.try_divide(
        F.log(F.col("n_both") * F.lit(float(total)) / (F.col("n_term") * F.col("n_entity"))), F.log(F.lit(float(total)) / F.col("n_entity"))
    )
    scored = pairs.join(counts, "term").join(entities, "entity").select("term", "entity", F.round(ratio, 9).alias("disclosure"))
    return scored.where(F.col("disclosure") >= generalise_at)


def find_spans(docs: DataFrame, text: str = "text", generalise_at: float = GENERALISE_AT, remove_at: float = REMOVE_AT, min_contexts: int = MIN_CONTEXTS) -> DataFrame:
    """Add ``pii_spans``, all spans by start and kind, to every document.

    Terms have the kind "term" and as value "remove" or "generalise".
    """
    spans, row, added = "pii_spans", fresh_name(docs.schema, "row"), "term_spans"
    docs = docs.drop(spans)
    kept = docs.columns
    marked = docs.select(F.monotonically_increasing_id().alias(row), *[F.col(f"`{c}`") for c in kept], entity_spans(F.coalesce(F.col(text), F.lit(""))).alias(spans))
    marked = settle(marked, "entity-spans")
    scanned = marked.select(F.col(row).alias("row"), F.coalesce(F.col(text), F.lit("")).alias("text"), F.col(spans).alias("spans"))
    mentions, places = _mentions(scanned, min_contexts)
    disclosing = disclosing_terms(marked, text, mentions, min_contexts, generalise_at)
    action = F.when(F.col("disclosure") >= remove_at, "remove").otherwise("generalise")
    # Several entities of a line may ask for one term; "remove" is the larger word and wins.
    terms = (
        mentions.join(disclosing, ["term", "entity"])
        .groupBy("row", "line", "term").agg(F.max(action).alias("value"))
        .join(places, ["row", "line", "term"])
        .groupBy("row").agg(F.collect_list(F.struct(F.col("start"), F.lit(len(KINDS)).alias("rank"), F.col("end"), F.lit("term").alias("kind"), F.col("value"))).cast(SPANS).alias(added))
        .withColumnRenamed("row", row).withColumnRenamed(added, fresh_name(marked.schema, added))
    )
    added = fresh_name(marked.schema, added)
    joined = marked.join(terms, row, "left")
    every = F.when(F.col(added).isNull(), F.col(spans)).otherwise(F.sort_array(F.concat(F.col(spans), F.col(added))))
    return joined.select(*[F.col(f"`{c}`") for c in kept], every.alias(spans))


def _stand_in(span: Column, value: Column) -> Column:
    term_class = F.when(F.rlike(value, F.lit("^[0-9]+$")), "[NUMBER]").when(F.rlike(value, F.lit(r"^\p{Lu}")), "[NAME]").otherwise("[TERM]")
    label = F.when(span["value"] == "remove", "").otherwise(term_class)
    for kind in KINDS:
        label = F.when(span["kind"] == kind, LABELS[kind]).otherwise(label)
    return label


def sanitised_text(text: Column, spans: Column) -> Column:
    """The text with every span replaced; spans that overlap are replaced as one, by the first's stand-in.

    Spans are taken in blocks of ``STEP``, each with its own stretch of the text.
    """

    def block(b: Column, ends: Column) -> Column:
        own = F.slice(spans, b * STEP + 1, STEP)

        def within(bounds: Column) -> Column:
            def cut(stretch: Column) -> Column:
                def part(start: Column, end: Column) -> Column:
                    return F.substring(stretch, start - bounds["low"] + 1, end - start)

                def add(state: Column, span: Column) -> Column:
                    fresh = span["start"] >= state["at"]
                    both = F.array(part(state["at"], span["start"]), _stand_in(span, part(span["start"], span["end"])))
                    parts = F.when(fresh, F.concat(state["parts"], both)).otherwise(state["parts"]).cast("array<string>")
                    return F.struct(F.greatest(state["at"], span["end"]).alias("at"), parts.alias("parts"))

                nothing = F.struct(bounds["low"].alias("at"), F.array().cast("array<string>").alias("parts"))
                return F.aggregate(own, nothing, add, lambda s: F.array_join(s["parts"], ""))

            return let(F.substring(text, bounds["low"] + 1, bounds["high"] - bounds["low"]), cut)

        low = F.coalesce(F.array_max(F.slice(ends, F.lit(1), b)), F.lit(0))
        return let(F.struct(low.alias("low"), F.greatest(low, F.get(ends, b)).alias("high")), within)

    def whole(ends: Column) -> Column:
        blocks = F.transform(ends, lambda _, b: block(b, ends))
        return F.concat(F.array_join(blocks, ""), F.substring(text, F.array_max(ends) + 1, F.length(text)))

    numbers = F.sequence(F.lit(0), ((F.size(spans) - 1) / STEP).cast("int"))
    ends = F.transform(numbers, lambda b: F.array_max(F.transform(F.slice(spans, b * STEP + 1, STEP), lambda s: s["end"])))
    return F.when(F.size(spans) > 0, let(ends, whole)).otherwise(text)


def sanitise(docs: DataFrame, text: str = "text", **thresholds) -> DataFrame:
    """All documents with entities replaced and disclosing terms generalised or removed."""
    docs, back = sheltered(docs, ["pii_spans"])
    found = find_spans(docs, text, **thresholds)
    return found.withColumn(text, sanitised_text(F.col(text), F.col("pii_spans"))).select(*back)


def _written(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def private_report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Counts per kind, a digest of the entity spans, and all spans of every document."""
    found = find_spans(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")))
    base = F.filter("pii_spans", lambda s: s["kind"] != "term")

    def count(kind: str) -> Column:
        return F.size(F.filter("pii_spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *map(count, KINDS), F.sha2(_written(base), 256).alias("base_sha256"), _written(F.col("pii_spans")).alias("spans"))
