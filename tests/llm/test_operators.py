"""Small cases of the corpus operators: nulls, empty and odd texts, ties, repeats, clashing columns, empty tables."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import archives, decontaminate, licenses, lm_score, packing, quality, simhash
from millrace.llm.components import connected_components


def docs_of(spark, texts, columns="doc_id long, text string"):
    return spark.createDataFrame(list(enumerate(texts)), columns)


# Licenses


def test_license_templates(spark):
    texts = [
        "Licensed under the Apache License, Version 2.0 (the License)",
        "licensed under the apache license 2.0",
        "MIT License\n\nCopyright (c) 2020 A. Nother and friends\n\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software and "
        "associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, "
        "merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
        "following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS",
        "permission is hereby granted free of charge to any person",
        "mit licensed, MIT LICENSE mit. license",
        None,
        "",
    ]
    got = {r.doc_id: r for r in licenses.license_report(docs_of(spark, texts)).collect()}
    assert got[0].labels == "apache,apache-2.0-notice" and got[0].score == 1.0
    assert got[1].labels == "apache" and got[1].score == 0.5
    assert got[2].labels == "mit,mit-text" and (got[2].first_word, got[2].last_word) == (0, 0)
    assert got[3].labels == "" and got[3].first_word is None
    # The no-break space is no ASCII character, so it belongs to the word.
    assert (got[4].n_base, got[4].first_word) == (1, 3)
    assert (got[5].n_words, got[5].labels, got[5].score) == (0, "", 0.0) and got[6].n_words == 0


def test_templates_must_start_with_a_word():
    for markup in ("[[only]] [[optional]]", "{{*3}} word", "[[open", "under [[a|the]] license"):
        with pytest.raises(ValueError):
            licenses.Automaton(licenses.Template("x", markup))


def test_whole_templates_span_the_text():
    scanner = licenses.Scanner([licenses.Template("x", "a [[b]] {{c|d e}}", whole=True)])
    assert [bool(scanner.places(w.encode().split())) for w in ("a c", "a b d e", "a d", "a c f", "z a c")] == [True, True, False, False, False]


PUBLIC = {
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free "
    "Software Foundation, either version 3 of the License, or (at your option) any later version.": "gpl,gpl-3.0-notice",
    "You may use it under the terms of the GNU Lesser General Public License, version 2.1": "gpl,lgpl-notice",
    "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.": "cc-by-nc-4.0-notice",
    "This work is licensed under the Creative Commons Attribution 4.0 International License.": "cc-by-4.0-notice",
    "Licensed under CC BY 4.0": "cc-by-4.0-notice",
    "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.": "mpl-2.0-notice",
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. "
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in "
    "binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials "
    "provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products "
    "derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND "
    "ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE "
    "DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL "
    "DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER "
    "CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE "
    "USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.": "bsd-conditions,bsd-text",
}
MIT_FILE = (
    "MIT License\n\nCopyright (c) 2024 Someone\n\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
    "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, "
    "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
    "following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\n"
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, "
    "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER "
    "LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN "
    "THE SOFTWARE."
)


def test_public_license_texts(spark):
    import duckdb
    from millrace.llm.queries import LICENSE_SQL

    texts = {**PUBLIC, MIT_FILE: "mit,mit-file,mit-text", "see below " + MIT_FILE: "mit,mit-text", MIT_FILE.replace("TORT", "court"): "mit,mit-text"}
    documents = docs_of(spark, list(texts)).toPandas()  # noqa: F841
    got = {r.doc_id: r for r in licenses.license_report(docs_of(spark, list(texts))).collect()}
    assert [got[i].labels for i in range(len(texts))] == list(texts.values())
    rows = duckdb.sql(LICENSE_SQL + " ORDER BY doc_id")
    at = rows.columns.index("labels")
    assert [r[at] for r in rows.fetchall()] == list(texts.values())


# Decontamination


def brute_hits(words, windows):
    return {k for n in {len(w) for w in windows} for i in range(len(words) - n + 1) if tuple(words[i : i + n]) in windows for k in range(i, i + n)}


@pytest.mark.parametrize("block_words", [1_000_000, 20])
def test_windows_equal_brute_force(spark, block_words):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(6)]
    items = [(f"i{k}", " ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 3, 4, 5, 9])))) for k in range(12)] + [(None, "w1 w2 w3 w4 w5"), ("i0", "zz"), ("n", None)]
    texts = [" ".join(rng.choice([*words, "x"]) for _ in range(rng.randrange(60))) for _ in range(40)] + [None, "", "w1 " * 3000]
    benchmark = spark.createDataFrame(items, "item_id string, text string")
    found = decontaminate.scan_windows(docs_of(spark, texts), benchmark, window=4, block_words=block_words).collect()
    windows = {}
    for item, text in items:
        body = (text or "").split()
        for i in range(max(1, len(body) - 3) if body else 0):
            windows.setdefault(tuple(body[i : i + 4]), set()).add(item or "")
    for row in found:
        body = (texts[row.doc_id] or "").split()
        hits = brute_hits(body, windows)
        assert {k for s in row.hit_words for k in range(s["first"], s["last"] + 1)} == hits
        present = {o for n in {len(w) for w in windows} for i in range(len(body) - n + 1) for o in windows.get(tuple(body[i : i + n]), ())}
        assert row.hit_items == sorted(present)


def test_spans_are_cut_and_documents_dropped(spark):
    benchmark = spark.createDataFrame([("i", "one two three")], "item_id string, text string")
    docs = spark.createDataFrame([(1, "é. One, TWO three! four", 5), (2, "clean one two", 6), (3, None, 7)], "doc_id long, text string, n_words int")
    cut = {r.doc_id: (r.text, r.n_words) for r in decontaminate.cut_spans(docs, benchmark).collect()}
    assert cut == {1: ("é. ! four", 5), 2: ("clean one two", 6), 3: (None, 7)}
    assert {r.doc_id for r in decontaminate.drop_contaminated(docs, benchmark).collect()} == {2, 3}
    assert decontaminate.contamination_report(docs.where("false"), benchmark).collect() == []
    assert decontaminate.contamination_report(docs, benchmark.where("false")).where("n_hit > 0").collect() == []


# Archives


def test_both_arc_versions_and_odd_content():
    http = b"HTTP/1.0 200 OK\r\nA: b\r\n\r\n\x00\xff\nhttp://x 1 2 3 4\n"
    for version in (1, 2):
        data = archives.version_block("a.arc", version) + archives.arc_record("http://a b/", http, version, "199912312359") + archives.arc_record("http://c/", b"", version, "20200101000000")
        first, second = archives.parse_arc(data)
        assert first.content == http and first.fields["URL"] == "http://a b/" and second.content == b""
        assert archives.warc_date(first.fields["Archive-date"]) == "1999-12-31T23:59:00Z"
        (short,) = archives.parse_arc(data[: data.index(b"\xff")])
        assert short.truncated and not first.truncated
    with pytest.raises(ValueError):
        list(archives.parse_arc(b"http://a 0.0.0.0 20200101000000 text/html 0\n\n"))


def test_warc_round_trip(spark, tmp_path):
    rows = [(1, "u 1", "same"), (2, "u2", "same"), (2, "u3", "same"), (None, "u4", "same"), (3, None, None), (4, "u5", ""), (5, "u6", "é\r\n\r\nWARC/1.1\r\n"), (6, "u7", "x" * 100_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)
    report = archives.archive_report(pages).collect()
    assert len(report) == len(rows)
    assert sorted((r.page_id is None, r.record_type) for r in report if r.payload_bytes == 4) == [(False, "response"), (False, "revisit"), (False, "revisit"), (True, "revisit")]
    assert all(r.refers_to == 2 for r in report if r.payload_bytes == 4 and r.record_type == "revisit")
    assert {(r.page_id, r.record_type, r.refers_to) for r in report if r.payload_bytes == 0} == {(3, "revisit", 4), (4, "response", None)}
    path = archives.convert(spark, archives.write_arc(pages, str(tmp_path / "arc"), records=3), str(tmp_path / "warc"))
    read = {r.page_id: bytes(r.payload).decode() for r in archives.read_warc(spark, path, with_payload=True).where("record_type = 'response'").collect()}
    assert read[5] == rows[6][2] and read[6] == rows[7][2]
    assert archives.archive_report(pages.where("false")).collect() == []


# Quality


def test_rules_run_by_rejections_per_second():
    rules = list(quality.RULES[:3])
    profiles = [quality.Profile(rules[0], 1.0, 0.1), quality.Profile(rules[1], 4.0, 0.8), quality.Profile(rules[2], 1.0, 0.15)]
    assert quality.ordered_rules(profiles) == [rules[1], rules[2], rules[0]]


def test_quality_of_odd_texts(spark):
    loop = "a b c d e f g h i j " * 3
    texts = [None, "", "one two", "ok " + " ".join(f"word{chr(97 + i)}" for i in range(20)), loop, "w " * 20_000, " \t\x0b\x0c\r\n "]
    report = {r.doc_id: r for r in quality.quality_report(docs_of(spark, texts)).collect()}
    assert [report[i].kept for i in range(7)] == [False, False, False, True, False, False, False]
    assert report[4].n_repeat_words == 30 and report[5].n_repeat_words == 20_000 and report[6].n_words == 0
    docs = docs_of(spark, texts).withColumn("n_words", F.lit("mine"))
    assert [tuple(r) for r in quality.keep_good(docs).collect()] == [(3, texts[3], "mine")]
    assert quality.keep_good(docs.where("false")).collect() == []


# SimHash


@pytest.mark.parametrize("block", [8192, 3])
def test_links_connect_like_all_pairs(spark, block):
    rng = random.Random(5)
    centres = [rng.getrandbits(64) for _ in range(4)]
    values = {c ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(4))) for c in centres for _ in range(12)} | {rng.getrandbits(64) for _ in range(20)} | {0}
    values = sorted(v - (1 << 64) if v >= 1 << 63 else v for v in values)
    root = {v: v for v in values}
    for a in values:
        for b in values:
            if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= 4:
                low, high = sorted((root[a], root[b]))
                root = {k: low if r == high else r for k, r in root.items()}
    links = simhash.fingerprint_links(spark.createDataFrame([(v,) for v in values], "fp long"), "fp", block=block)
    got = {r.node: r.root for r in connected_components(links, "one", "other").collect()}
    assert {v: got.get(v, v) for v in values} == root


def test_components_of_a_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 130)] + [(7, 7), (None, 3)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 130)}


def test_one_document_of_each_group_stays(spark):
    body = " ".join(f"w{i}" for i in range(40))
    rows = [(1, body, "x"), (2, body.upper(), "x"), (3, "other words entirely here now", "x"), (4, None, "x"), (5, "  ", "x"), (None, body, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, leaves string")
    assert sorted(str(r.doc_id) for r in simhash.keep_one(docs).collect()) == ["1", "3", "4", "None"]
    assert simhash.near_duplicate_groups(docs.where("false")).collect() == []


# Scores


def test_scores_survive_odd_texts(spark):
    docs = spark.createDataFrame([(1, "a b a"), (2, None), (3, ""), (None, "b a"), (4, "q")], "doc_id long, text string")
    got = {r.doc_id: (r.n_words, r.score) for r in lm_score.score_documents(docs, order=2, block_bytes=3, part_bytes=2).collect()}
    # Elsewhere "a" and "b" come up once each among three words, and "b a" once.
    a, pair, back = 0.4 * 1 / 3, 1 / 1, 0.4 * 1 / 3
    assert got[1] == (3, pytest.approx((np.log10(a) + np.log10(back) + np.log10(pair)) / 3))
    assert got[2] == got[3] == (0, None)
    assert got[4] == (1, pytest.approx(np.log10(0.16 / 5)))
    assert lm_score.score_documents(docs.where("false")).collect() == []


@pytest.mark.parametrize("order", [1, 2, 3, 5])
def test_scores_of_every_order(spark, order):
    rng = random.Random(order)
    texts = [" ".join(rng.choices("abcd", k=rng.randrange(0, 30))) for _ in range(25)]
    texts += [texts[3]] * 2 + ["a", None, "zz unseen words", " ".join("ab" * 40)]
    words = [(t or "").split() for t in texts]

    def grams(ws):
        return Counter(tuple(ws[i : i + k]) for k in range(1, order + 1) for i in range(len(ws) - k + 1))

    own = [grams(ws) for ws in words]
    total = sum(own, Counter())
    n = sum(map(len, words))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_words, r.score) for r in lm_score.score_documents(docs, order=order, block_bytes=100, part_bytes=90).collect()}
    assert len(got) == len(texts)
    for d, ws in enumerate(words):
        logs = []
        for i in range(len(ws)):
            value, steps = None, order
            for k in range(min(order, i + 1), 0, -1):
                gram = tuple(ws[i - k + 1 : i + 1])
                if total[gram] > own[d][gram]:
                    below = total[gram[:-1]] - own[d][gram[:-1]] if k > 1 else max(1, n - len(ws))
                    value, steps = (total[gram] - own[d][gram]) / below, order - k
                    break
            logs.append(np.log10(0.4**steps * (1 / max(1, n - len(ws)) if value is None else value)))
        assert got[d] == (len(ws), pytest.approx(np.mean(logs)) if ws else None)


# Packing


def test_plans_use_every_piece_and_fit():
    rng = random.Random(6)
    for _ in range(30):
        counts = {rng.randrange(1, 65): rng.randrange(1, 50) for _ in range(rng.randrange(1, 40))}
        used = {}
        plan = packing.plan_bins(dict(counts), 64)
        for planned in plan:
            assert sum(planned.lengths) <= 64 and planned.times > 0
            for length in planned.lengths:
                used[length] = used.get(length, 0) + planned.times
        assert used == counts
        assert len(plan) <= 64
        bound = -(-sum(k * n for k, n in counts.items()) // 64)
        assert sum(p.times for p in plan) >= bound


def test_two_pieces_replace_the_smallest():
    # Greedy takes 60 and 30; 38 is too long for the gap, but 20 and 19 fill 40 - 1.
    plan = packing.plan_bins({60: 1, 30: 1, 20: 1, 19: 1}, 100)
    assert plan[0].lengths == (60, 20, 19)


def test_packed_ids_equal_the_tokenizers(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.default_tokenizer())
    tokenizer.encode_special_tokens = True
    texts = ["", None, "one two", "one  two", "a\n\nb", "a \n b.", "it's, ok.,", " lead", "trail ", "x\n", "é ü", "word " * 3000, "one two", "<|endoftext|> a", "a\x85b\x1cc"]
    packed = packing.pack_documents(docs_of(spark, texts), packing.default_tokenizer(), capacity=64, with_ids=True).collect()
    joined = {}
    for row in sorted(packed, key=lambda r: (r.doc_id, r.piece)):
        ids = np.frombuffer(bytes(row.ids), "<u4").tolist()
        assert row.ids_crc32 == zlib.crc32(bytes(row.ids)) and row.length == len(ids) and row.start == len(joined.setdefault(row.doc_id, []))
        joined[row.doc_id] += ids
    assert joined == {i: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2] for i, t in enumerate(texts)}
    places = {}
    for row in packed:
        places.setdefault(row.sequence_id, []).append((row.offset, row.length))
    for sequence in places.values():
        assert [o for o, _ in sorted(sequence)] == np.cumsum([0] + [n for _, n in sorted(sequence)])[:-1].tolist()
        assert sum(n for _, n in sequence) <= 64
    assert packing.pack_documents(docs_of(spark, texts).where("false"), packing.default_tokenizer()).collect() == []


def test_digests_are_of_bytes():
    assert archives.base32_sha1(b"") == "3I42H3S6NNFQ2MSVX7XZKYAYSCX5QBYJ"
    assert hashlib.sha1(b"").hexdigest().startswith("da39a3ee")
