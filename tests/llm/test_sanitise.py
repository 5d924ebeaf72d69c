"""Personal data: entity spans against Python's regex engine, disclosing terms against brute force."""

import math
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from millrace.llm import sanitise

PATTERNS = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
]


def valid(kind, value):
    digits = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(part) <= 255 for part in value.split("."))
    if kind == "card":
        doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
        return 14 <= len(digits) <= 19 and sum(d - 9 if d > 9 else d for d in doubled) % 10 == 0
    return 10 <= len(digits) <= 15 if kind == "phone" else True


def entities(text):
    return sorted((m.start(), i, m.end(), k) for i, (k, p) in enumerate(PATTERNS) for m in re.finditer(p, text or "") if valid(k, m.group()))


TEXTS = [
    None,
    "",
    "a@b.c_x@d.e and é😀 me@mail-1.example.com.",
    "1.2.3.4.5 300.1.1.1 000255.1.1.1 1.2.3",
    "4111 1111 1111 1111, 4111-1111-1111-1112, 45 12463504900732",
    "+1 (372) 555-2774 +12 +1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6 +44.20.7946.0958.",
    "+4111111111111111 x@1.2.3.4",
    "9 " * 30_000,
    "a" * 50_000 + "@",
    "x@" + "a." * 20_000 + "b",
    "1." * 20_000,
]


@pytest.fixture(scope="module")
def spans(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(2, TEXTS[2]), (None, "z@z.zz")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return sanitise.private_report(docs).collect()


def test_entity_spans_equal_pythons(spans):
    assert len(spans) == len(TEXTS) + 2
    for row in spans:
        text = "z@z.zz" if row.doc_id is None else TEXTS[row.doc_id]
        found = entities(text)
        assert [s for s in row.spans.split(",") if s and not s.startswith("term")] == [f"{k}:{a}:{b}" for a, _, b, k in found]
        assert [row.n_email, row.n_ip, row.n_card, row.n_phone] == [sum(f[3] == k for f in found) for k, _ in PATTERNS]


LINES = [
    "Falcon wrote to joe@x.org today",
    "the report by falcon for joe@x.org is late\nthe weather is fine",
    "nothing here today is the report",
    "the mail of ann@y.org",
    "the mail of ann@y.org",
    "late mail and fine weather\ncall +1 372 555 2774 or falcon",
]


def brute(lines_of_docs, generalise_at=0.9, remove_at=1.0):
    lines = [(d, line) for d, text in enumerate(lines_of_docs) for line in text.split("\n")]
    word = re.compile(r"[^\W_]+")
    terms_of = [set(word.findall(line.lower())) for _, line in lines]
    lines = [line for line, terms in zip(lines, terms_of, strict=True) if terms]
    terms_of = [t for t in terms_of if t]
    n_term, n_entity, both, texts = defaultdict(int), defaultdict(int), defaultdict(int), defaultdict(set)
    for (_, line), terms in zip(lines, terms_of, strict=True):
        for t in terms:
            n_term[t] += 1
        found = entities(line)
        outside = {m.group().lower() for m in word.finditer(line) if not any(a < m.end() and m.start() < b for a, _, b, _ in found)}
        for e in {line[a:b] for a, _, b, _ in found}:
            n_entity[e] += 1
            for t in outside:
                both[t, e] += 1
                texts[t, e].add(line)
    out = set()
    for (t, e), n in both.items():
        ratio = math.log(n * len(lines) / (n_term[t] * n_entity[e])) / math.log(len(lines) / n_entity[e])
        if len(texts[t, e]) > 1 and round(ratio, 9) >= generalise_at:
            out.add((t, e, "remove" if round(ratio, 9) >= remove_at else "generalise"))
    return out


def test_disclosing_terms_equal_brute_force(spark):
    docs = spark.createDataFrame(list(enumerate(LINES)), "doc_id long, text string")
    found = sanitise.find_spans(docs, generalise_at=0.3).collect()
    want = brute(LINES, 0.3)
    assert want
    got = {(LINES[r.doc_id][s.start : s.end].lower(), s.value) for r in found for s in r.pii_spans if s.kind == "term"}
    assert got == {(t, action) for t, _, action in want}


def test_terms_that_always_stand_with_an_entity_are_removed(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(LINES[:5])], "doc_id long, text string")
    out = {r.doc_id: r.text for r in sanitise.sanitise(docs).collect()}
    assert out[0] == " wrote to [EMAIL] today"
    assert out[1] == "the report by  for [EMAIL] is late\nthe weather is fine"
    assert out[2] == LINES[2]
    # Two equal lines are one context, so they say nothing about their words.
    assert out[3] == "the mail of [EMAIL]"


def test_clashing_columns_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "me@x.org", 7, 8, 9)], "doc_id long, text string, row int, term_spans int, pii_spans int")
    assert sanitise.sanitise(docs).collect() == [(1, "[EMAIL]", 7, 8, 9)]
    assert sanitise.sanitise(docs.where(F.lit(False))).collect() == []


@pytest.mark.parametrize("step", [1, 3, 128])
def test_lines_of_many_blocks_of_matches(spark, monkeypatch, step):
    """Spans and texts do not depend on how many matches are put together at once."""
    monkeypatch.setattr(sanitise, "STEP", step)
    words = [f"w{i % 40}" if i % 9 else f"é{i}@m{i % 5}.org" if i % 2 else "+4111111111111111" for i in range(400)]
    texts = [" ".join(words), "x " + " ".join(words) + "\nlast w1", "\n\na@b.cd", "+4111111111111111 x@1.2.3.4 y"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for row in sanitise.private_report(docs).collect():
        assert [s for s in row.spans.split(",") if not s.startswith("term")] == [f"{k}:{a}:{b}" for a, _, b, k in entities(texts[row.doc_id])]
    found = {r.doc_id: r.pii_spans for r in sanitise.find_spans(docs, generalise_at=0.3, remove_at=0.6).collect()}
    out = {r.doc_id: r.text for r in sanitise.sanitise(docs, generalise_at=0.3, remove_at=0.6).collect()}
    for d, text in enumerate(texts):
        at, parts = 0, []
        for s in found[d]:
            if s.start >= at:
                value = text[s.start : s.end]
                word = "[NUMBER]" if re.fullmatch("[0-9]+", value) else "[NAME]" if value[0].isupper() else "[TERM]"
                label = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]"}.get(s.kind, "" if s.value == "remove" else word)
                parts += [text[at : s.start], label]
            at = max(at, s.end)
        assert out[d] == "".join(parts) + text[at:]
