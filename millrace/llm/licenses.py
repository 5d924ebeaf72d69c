"""License scan: template markup compiled to token automata.

A template is license text with markup: ``[[ ... ]]`` is a region that may be
left out, ``{{a|b}}`` takes any one of the listed wordings, and ``{{*n}}`` up
to n words of any kind. Everything else is mandatory wording. Each template
becomes an automaton whose edges are words; all automata run together from
every word that can start one, and a place is accepted only if the mandatory
wording stands there word for word. A template marked ``whole`` is accepted
only if it spans the text from its first to its last word.

Defined results: null and empty texts have no words, labels or places; equal
rows are judged each on its own; an empty table gives an empty table; other
columns stay, and ones named as an added column are replaced by it.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.text import add_columns, alnum_words

_MARKUP = re.compile(r"(\[\[|\]\]|\{\{.*?\}\})", re.S)


@dataclass(frozen=True)
class Template:
    """A label and the marked-up wording that earns it."""

    label: str
    markup: str
    whole: bool = False


# Fixed wordings that name a license.
PHRASES = (
    Template("mit", "mit license"),
    Template("apache", "apache license"),
    Template("gpl", "general public license"),
)

# Fixed wordings: grants, notices and whole texts as their publishers have them.
TEMPLATES = (
    Template("apache-2.0-notice", "licensed under the apache license [[,]] version 2.0 [[the license]]"),
    Template("mit-notice", "{{released|licensed|distributed|available}} under the [[terms of the]] mit license"),
    Template(
        "gpl-3.0-notice",
        """under the [[terms of the]] gnu general public license [[as published by the free software foundation]] [[either]]
        {{version|v}} 3 [[of the license]] [[or [[at your option]] any later version]]""",
    ),
    Template(
        "lgpl-notice",
        """under the [[terms of the]] gnu {{lesser|library}} general public license [[as published by the free software foundation]]
        [[either]] {{version|v}} {{2|2.1|3}} [[of the license]] [[or [[at your option]] any later version]]""",
    ),
    Template("mpl-2.0-notice", "this source code form is subject to the terms of the mozilla public license v 2.0"),
    Template("cc-by-nc-4.0-notice", "licensed under [[{{a|the}}]] {{cc by nc|creative commons attribution noncommercial}} 4.0 [[international license]]"),
    Template("cc-by-4.0-notice", "licensed under [[{{a|the}}]] {{cc by|creative commons attribution}} 4.0 [[international license]]"),
    Template(
        "mit-text",
        """[[mit license]] [[copyright [[c]] {{*12}}]] permission is hereby granted free of charge to any person obtaining a copy of this
        software and associated documentation files the software to deal in the software without restriction including without
        limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit
        persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this
        permission notice [[including the next paragraph]] shall be included in all copies or substantial portions of the software
        the software is provided as is without warranty of any kind""",
    ),
    Template(
        "mit-file",
        """[[the]] {{mit license|mit license mit}} [[copyright [[c]] {{*12}}]] permission is hereby granted free of charge to any
        person obtaining a copy of this software and associated documentation files the software to deal in the software without
        restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies
        of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above
        copyright notice and this permission notice [[including the next paragraph]] shall be included in all copies or substantial
        portions of the software the software is provided as is without warranty of any kind express or implied including but not
        limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors
        or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise
        arising from out of or in connection with the software or the use or other dealings in the software""",
        whole=True,
    ),
    Template(
        "bsd-conditions",
        """redistribution and use in source and binary forms with or without modification are permitted provided that the following
        conditions are met [[1]] redistributions of source code must retain the above copyright notice this list of conditions and
        the following disclaimer [[2]] redistributions in binary form must reproduce the above copyright notice""",
    ),
    Template(
        "bsd-text",
        """redistribution and use in source and binary forms with or without modification are permitted provided that the following
        conditions are met [[1]] redistributions of source code must retain the above copyright notice this list of conditions and
        the following disclaimer [[2]] redistributions in binary form must reproduce the above copyright notice this list of conditions
        and the following disclaimer in the documentation and or other materials provided with the distribution [[[[3]] neither the name
        of {{*12}} nor the names of its contributors may be used to endorse or promote products derived from this software without
        specific prior written permission]] this software is provided by the {{copyright holders|authors|regents}} and contributors as is
        and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a
        particular purpose are disclaimed in no event shall the {{copyright holder|copyright owner|copyright holders|authors|regents}} or contributors be liable
        for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of
        substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability
        whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software
        even if advised of the possibility of such damage""",
    ),
    Template(
        "isc-text",
        """permission to use copy modify and {{or|and or}} distribute this software for any purpose with or without fee is hereby
        granted provided that the above copyright notice and this permission notice appear in all copies""",
    ),
)


@dataclass
class State:
    """One state of an automaton: word edges, edges for any word, and edges without a word."""

    words: dict[bytes, set[int]] = field(default_factory=dict)
    anything: set[int] = field(default_factory=set)
    free: set[int] = field(default_factory=set)


class Automaton:
    """The compiled form of one template."""

    def __init__(self, template: Template):
        self.template = template
        self.states = [State()]
        at = self._sequence(_MARKUP.split(template.markup), 0)
        self.final = at
        self.starts = {w for s in self._closed({0}) for w in self.states[s].words}
        if any(self.states[s].anything for s in self._closed({0})) or self.final in self._closed({0}):
            raise ValueError(f"Template {template.label} must start with a fixed word")

    def _new(self) -> int:
        self.states.append(State())
        return len(self.states) - 1

    def _words(self, text: str, at: int) -> int:
        for word in alnum_words(text):
            after = self._new()
            self.states[at].words.setdefault(word, set()).add(after)
            at = after
        return at

    def _sequence(self, parts: list[str], at: int) -> int:
        opened: list[int] = []
        for part in parts:
            if part == "[[":
                opened.append(at)
            elif part == "]]":
                self.states[opened.pop()].free.add(at)
            elif part.startswith("{{*"):
                for _ in range(int(part[3:-2])):
                    after = self._new()
                    self.states[at].anything.add(after)
                    self.states[at].free.add(after)
                    at = after
            elif part.startswith("{{"):
                joint = self._new()
                for wording in part[2:-2].split("|"):
                    self.states[self._words(wording, at)].free.add(joint)
                at = joint
            elif "|" in part:
                raise ValueError(f"Template {self.template.label} has alternatives outside of braces")
            else:
                at = self._words(part, at)
        if opened:
            raise ValueError(f"Template {self.template.label} leaves an optional region open")
        return at

    def _closed(self, states: set[int]) -> frozenset[int]:
        todo, seen = list(states), set(states)
        while todo:
            for after in self.states[todo.pop()].free - seen:
                seen.add(after)
                todo.append(after)
        return frozenset(seen)


class Scanner:
    """Deterministic form of several automata, built as texts need it."""

    def __init__(self, templates: Sequence[Template]):
        self.automata = [Automaton(t) for t in templates]
        self.start = [(k, a._closed({0})) for k, a in enumerate(self.automata)]
        self.by_word: dict[bytes, list[int]] = {}
        for k, automaton in enumerate(self.automata):
            for word in automaton.starts:
                self.by_word.setdefault(word, []).append(k)
        self.steps: dict[tuple[int, frozenset, bytes], frozenset] = {}
        self.known = {w for a in self.automata for s in a.states for w in s.words}

    def _step(self, k: int, states: frozenset, word: bytes) -> frozenset:
        # Words that no template has all take the same edges.
        key = (k, states, word if word in self.known else b"")
        if key not in self.steps:
            automaton = self.automata[k]
            after: set[int] = set()
            for s in states:
                after |= automaton.states[s].words.get(key[2], set()) | automaton.states[s].anything
            self.steps[key] = automaton._closed(after)
        return self.steps[key]

    def longest(self, k: int, words: list[bytes], at: int) -> int | None:
        """One past the last word of the longest match of automaton ``k`` at a word."""
        automaton, states, end = self.automata[k], self.start[k][1], None
        for i in range(at, len(words)):
            states = self._step(k, states, words[i])
            if not states:
                break
            if automaton.final in states:
                end = i + 1
        return end

    def places(self, words: list[bytes]) -> list[tuple[int, int, str]]:
        """All accepted places as (first word, one past the last word, label)."""
        found = []
        by_word = self.by_word
        for at in [i for i, w in enumerate(words) if w in by_word]:
            for k in by_word[words[at]]:
                end = self.longest(k, words, at)
                if end is not None:
                    template = self.automata[k].template
                    if not template.whole or (at == 0 and end == len(words)):
                        found.append((at, end, template.label))
        return found


_PLACE = T.StructType([T.StructField("first", T.LongType()), T.StructField("last", T.LongType()), T.StructField("label", T.StringType())])
ADDED = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("license_places", T.ArrayType(_PLACE))])


def scan_licenses(docs: DataFrame, text: str = "text", templates: Sequence[Template] = PHRASES + TEMPLATES) -> DataFrame:
    """Add n_words and license_places (first and last word from 0, label) to every document."""

    def make():
        scanner = Scanner(templates)

        def scan(texts: list) -> list[list]:
            counts, places = [], []
            for body in texts:
                words = alnum_words(body)
                counts.append(len(words))
                places.append([{"first": a, "last": b - 1, "label": label} for a, b, label in scanner.places(words)])
            return [counts, places]

        return scan

    return add_columns(docs, [text], ADDED, make)


def license_report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Places of the fixed phrases, all labels, and how sure the labels are.

    ``score`` is 1 with a template's full mandatory wording, a half with a
    naming phrase alone, and 0 with neither.
    """
    base = [t.label for t in PHRASES]
    found = scan_licenses(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")))
    named = F.filter("license_places", lambda p: p["label"].isin(base))
    labels = F.array_sort(F.array_distinct(F.transform("license_places", lambda p: p["label"])))
    base_labels = F.array_sort(F.array_distinct(F.transform(named, lambda p: p["label"])))
    return found.select(
        "doc_id",
        "n_words",
        F.size(named).cast("long").alias("n_base"),
        F.array_min(F.transform(named, lambda p: p["first"])).alias("first_word"),
        F.array_max(F.transform(named, lambda p: p["first"])).alias("last_word"),
        F.array_join(base_labels, ",").alias("base_labels"),
        F.array_join(labels, ",").alias("labels"),
        F.when(F.size(labels) > F.size(base_labels), 1.0).when(F.size(base_labels) > 0, 0.5).otherwise(0.0).alias("score"),
    )
