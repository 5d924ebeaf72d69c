"""One registered query per operator, and the pipeline, with SQL where SQL can say it."""

from __future__ import annotations

import re
from collections.abc import Callable

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import archives, decontaminate, fill_in_middle, html_blocks, licenses, lm_score, multiset_hash, packing, quality, sanitise, simhash, spelling, suffix_dedup
from millrace.session import prepare_session

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def registered(name: str, sql: str | None = None):
    def add(function):
        QUERIES[name] = function
        if sql is not None:
            SQL[name] = sql
        return function

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare_session(spark).read.parquet(f"{sf_dir}/{name}.parquet")


QUALITY_SQL = r"""
WITH worded AS (
  SELECT doc_id, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
windows AS (
  SELECT doc_id, pos, count(*) OVER (PARTITION BY doc_id, w) AS copies
  FROM (SELECT doc_id, pos, list_slice(words, pos, pos + 4) AS w
        FROM (SELECT doc_id, words, unnest(range(1, len(words) - 3)) AS pos FROM worded))),
covered AS (
  SELECT doc_id, sum(least(5, coalesce(pos - before, 5))) AS n
  FROM (SELECT doc_id, pos, lag(pos) OVER (PARTITION BY doc_id ORDER BY pos) AS before FROM windows WHERE copies > 1)
  GROUP BY doc_id),
measures AS (
  SELECT w.doc_id, len(words) AS n_words,
         length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS n_symbols,
         length(regexp_replace(text, '\PL+', '', 'g')) AS n_letters,
         len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
         coalesce(c.n, 0)::BIGINT AS n_repeat_words
  FROM worded w LEFT JOIN covered c ON w.doc_id = c.doc_id),
judged AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
         10 * n_symbols > n_words OR 2 * word_chars < 5 * n_words OR word_chars > 12 * n_words
           OR 2 * n_letters < word_chars OR 2 * n_dup_lines > n_lines AS more_failed
  FROM measures)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT more_failed AS kept
FROM judged
"""


@registered("op6_quality_rules", QUALITY_SQL)
def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_report(table(spark, sf_dir, "documents")).drop("rejected_by")


# A-Z in lower case and nothing else, then the alphanumeric words of a text.
ALNUM_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

DECONTAMINATE_SQL = f"""
WITH d AS (SELECT doc_id, {ALNUM_WORDS} AS words FROM documents),
b AS (SELECT item_id, {ALNUM_WORDS} AS words FROM benchmark),
item_windows AS (
  SELECT item_id, list_slice(words, i, i + 12) AS win
  FROM (SELECT item_id, words, unnest(range(1, len(words) - 11)) AS i FROM b WHERE len(words) >= 13)
  UNION
  SELECT item_id, words FROM b WHERE len(words) BETWEEN 1 AND 12),
lengths AS (SELECT DISTINCT len(win) AS n FROM item_windows),
doc_windows AS (
  SELECT doc_id, i, n, list_slice(words, i, i + n - 1) AS win
  FROM (SELECT doc_id, words, n, unnest(range(1, len(words) - n + 2)) AS i FROM d, lengths WHERE len(words) >= n)),
hits AS (SELECT doc_id, i, n, item_id FROM doc_windows JOIN item_windows USING (win)),
covered AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
          FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS id FROM hits) GROUP BY doc_id)
SELECT d.doc_id, len(words) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(words) AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)
"""


@registered("op4_benchmark_decontamination", DECONTAMINATE_SQL)
def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@registered("op8_simhash_near_dedup")
def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.near_duplicate_groups(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", simhash.hexadecimal(F.col("fingerprint")).alias("fingerprint"), "component_id")


@registered("op10_best_fit_packing")
def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack_documents(table(spark, sf_dir, "documents"), packing.default_tokenizer())
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


# What each template accepts, written from the texts, over words that each have a space after them.
_MIT = (
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software "
    "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell "
    "copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice "
    "and this permission notice (including the next paragraph )?shall be included in all copies or substantial portions of the software the software is "
    "provided as is without warranty of any kind "
)
_BSD = (
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met (1 )?"
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer (2 )?"
    "redistributions in binary form must reproduce the above copyright notice "
)
_LATER = "(as published by the free software foundation )?(either )?(version|v) %s (of the license )?(or (at your option )?any later version )?"
LICENSE_TEXTS = {
    "mit": "mit license ",
    "apache": "apache license ",
    "gpl": "general public license ",
    "apache-2.0-notice": "licensed under the apache license version 2 0 (the license )?",
    "mit-notice": "(released|licensed|distributed|available) under the (terms of the )?mit license ",
    "gpl-3.0-notice": "under the (terms of the )?gnu general public license " + _LATER % "3",
    "lgpl-notice": "under the (terms of the )?gnu (lesser|library) general public license " + _LATER % "(2|2 1|3)",
    "mpl-2.0-notice": "this source code form is subject to the terms of the mozilla public license v 2 0 ",
    "cc-by-nc-4.0-notice": "licensed under (a |the )?(cc by nc|creative commons attribution noncommercial) 4 0 (international license )?",
    "cc-by-4.0-notice": "licensed under (a |the )?(cc by|creative commons attribution) 4 0 (international license )?",
    "mit-text": _MIT,
    "mit-file": "^ (the )?mit license (mit )?(copyright (c )?([^ ]+ ){0,12})?" + _MIT + (
        "express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event "
        "shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise "
        "arising from out of or in connection with the software or the use or other dealings in the software $"
    ),
    "bsd-conditions": _BSD,
    "bsd-text": _BSD + (
        "this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution "
        "((3 )?neither the name of ([^ ]+ ){0,12}nor the names of its contributors may be used to endorse or promote products derived from this software "
        "without specific prior written permission )?this software is provided by the (copyright holders|authors|regents) and contributors as is and any "
        "express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are "
        "disclaimed in no event shall the (copyright holder|copyright owner|copyright holders|authors|regents) or contributors be liable for any direct "
        "indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use "
        "data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including "
        "negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage "
    ),
    "isc-text": "permission to use copy modify and (or|and or) distribute this software for any purpose with or without fee is hereby granted provided that "
    "the above copyright notice and this permission notice appear in all copies ",
}


def license_pattern(label: str) -> str:
    text = LICENSE_TEXTS[label]
    return text if text.startswith("^") else " " + text


def _phrase_places() -> str:
    tests = []
    for phrase in licenses.PHRASES:
        words = phrase.markup.split()
        tests.append("(" + " AND ".join(f"words[i + {k}] = '{w}'" for k, w in enumerate(words)) + ")")
    return "list_filter(range(1, len(words) + 1), lambda i: coalesce(" + " OR ".join(tests) + ", false))"


def _label_list(templates) -> str:
    cases = ", ".join(f"CASE WHEN regexp_matches(joined, '{license_pattern(t.label)}') THEN '{t.label}' END" for t in templates)
    return f"list_sort(list_filter([{cases}], lambda l: l IS NOT NULL))"


LICENSE_SQL = f"""
WITH worded AS (SELECT doc_id, {ALNUM_WORDS} AS words FROM documents),
placed AS (SELECT *, {_phrase_places()} AS places, ' ' || array_to_string(words, ' ') || ' ' AS joined FROM worded),
labelled AS (SELECT *, {_label_list(licenses.PHRASES)} AS base, {_label_list(licenses.PHRASES + licenses.TEMPLATES)} AS every FROM placed)
SELECT doc_id, len(words) AS n_words, len(places) AS n_base, list_min(places) - 1 AS first_word, list_max(places) - 1 AS last_word,
       array_to_string(base, ',') AS base_labels, array_to_string(every, ',') AS labels,
       CASE WHEN len(every) > len(base) THEN 1.0 WHEN len(base) > 0 THEN 0.5 ELSE 0.0 END::DOUBLE AS score
FROM labelled
"""


@registered("op1_license_templates", LICENSE_SQL)
def op1_license_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_report(table(spark, sf_dir, "documents"))


@registered("op2_personal_data")
def op2_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sanitise.private_report(table(spark, sf_dir, "documents"))


# Base32 of a SHA-1: each five hexadecimal digits are four characters.
ARCHIVE_SQL = """
WITH digests AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages),
numbered AS (SELECT *, list_transform(range(0, 8), lambda g: ('0x' || substr(hex, 5 * g + 1, 5))::INTEGER) AS parts FROM digests),
encoded AS (
  SELECT page_id, strlen(html) AS payload_bytes, list_aggregate(flatten(list_transform(parts, lambda v: list_transform([15, 10, 5, 0],
         lambda s: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((v >> s) & 31)::INTEGER + 1, 1)))), 'string_agg', '') AS payload_digest
  FROM numbered),
firsts AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS original FROM encoded)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = original THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> original THEN original END AS refers_to
FROM firsts
"""


@registered("op5_arc_to_warc", ARCHIVE_SQL)
def op5_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archives.archive_report(table(spark, sf_dir, "pages"))


@registered("op3_html_main_text")
def op3_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_blocks.main_text_report(table(spark, sf_dir, "pages"))


LM_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {ALNUM_WORDS} AS words FROM documents),
tokens AS (SELECT r, words[i] AS w, CASE WHEN i > 1 THEN words[i - 1] END AS v, CASE WHEN i > 2 THEN words[i - 2] END AS u, len(words) AS n
           FROM (SELECT r, words, unnest(range(1, len(words) + 1)) AS i FROM d)),
total AS (SELECT count(*) AS n FROM tokens),
singles AS (SELECT r, w, count(*) AS own, sum(count(*)) OVER (PARTITION BY w) AS c FROM tokens GROUP BY r, w),
pairs AS (SELECT r, v, w, count(*) AS own, sum(count(*)) OVER (PARTITION BY v, w) AS c FROM tokens WHERE v IS NOT NULL GROUP BY r, v, w),
triples AS (SELECT r, u, v, w, count(*) AS own, sum(count(*)) OVER (PARTITION BY u, v, w) AS c FROM tokens WHERE u IS NOT NULL GROUP BY r, u, v, w),
counted AS (
  SELECT t.r, t.n, s.c - s.own AS single, coalesce(p.c - p.own, 0) AS pair, coalesce(x.c - x.own, 0) AS triple,
         b.c - b.own AS before, bb.c - bb.own AS before_two, greatest(1, total.n - t.n) AS others
  FROM tokens t CROSS JOIN total JOIN singles s ON s.r = t.r AND s.w = t.w
  LEFT JOIN singles b ON b.r = t.r AND b.w = t.v LEFT JOIN pairs p ON p.r = t.r AND p.v = t.v AND p.w = t.w
  LEFT JOIN pairs bb ON bb.r = t.r AND bb.v = t.u AND bb.w = t.v
  LEFT JOIN triples x ON x.r = t.r AND x.u = t.u AND x.v = t.v AND x.w = t.w),
scored AS (
  SELECT r, log10(CASE WHEN triple > 0 THEN triple::DOUBLE / before_two::DOUBLE WHEN pair > 0 THEN 0.4::DOUBLE * pair::DOUBLE / before::DOUBLE
    WHEN single > 0 THEN pow(0.4::DOUBLE, 2) * single::DOUBLE / others ELSE pow(0.4::DOUBLE, 3) / others END) AS s
  FROM counted)
SELECT d.doc_id, len(d.words) AS n_words, round(sum(s) / len(d.words), 6) AS score
FROM d LEFT JOIN scored ON scored.r = d.r GROUP BY d.r, d.doc_id, d.words
"""


@registered("op9_lm_scores", LM_SQL)
def op9_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = lm_score.score_documents(table(spark, sf_dir, "documents"))
    return scored.select("doc_id", "n_words", F.round("score", 6).alias("score"))


@registered("op7_repeated_passages")
def op7_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeat_report(table(spark, sf_dir, "documents"))


MIDDLE_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS tokens,
         sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS draw
  FROM documents),
drawn AS (
  SELECT *, len(tokens) AS n, ('0x' || draw[1:8])::BIGINT AS h1, ('0x' || draw[9:16])::BIGINT AS h2,
         ('0x' || draw[17:24])::BIGINT AS h3, ('0x' || draw[25:32])::BIGINT AS h4
  FROM d),
formed AS (
  SELECT doc_id, n, text,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain'
              WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form,
         array_to_string(tokens[1:least(h1 % (n + 1), h2 % (n + 1))], '') AS prefix,
         array_to_string(tokens[least(h1 % (n + 1), h2 % (n + 1)) + 1:greatest(h1 % (n + 1), h2 % (n + 1))], '') AS middle,
         array_to_string(tokens[greatest(h1 % (n + 1), h2 % (n + 1)) + 1:], '') AS suffix
  FROM drawn)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                        ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM formed
"""


@registered("op11_fill_in_middle", MIDDLE_SQL)
def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_in_middle.middle_report(table(spark, sf_dir, "documents"))


# Sums over the paragraphs of a body of what their SHA-256 says: four 64-bit words, and 256 bits as 1 or -1.
MULTISET_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
followed AS (SELECT *, coalesce(lead(text) OVER (ORDER BY doc_id), first_value(text) OVER (ORDER BY doc_id)) AS following FROM d),
changed AS (SELECT *, substr(text, 1, length(text) - length(text) // 4) || substr(following, 1, length(text) // 4) AS after FROM followed),
bodies AS (SELECT doc_id, false AS edited, text AS body FROM changed UNION ALL SELECT doc_id, true, after FROM changed),
hashed AS (
  SELECT doc_id, edited, sha256(unnest(string_split(replace(body, '. ', '. ' || chr(10)), chr(10)))) AS h FROM bodies WHERE body <> ''),
words AS (
  SELECT doc_id, edited, string_agg(lpad(lower(to_hex(v::UBIGINT)), 16, '0'), '' ORDER BY k) AS words
  FROM (SELECT doc_id, edited, k, sum(('0x' || h[16 * k + 1:16 * k + 16])::UBIGINT::HUGEINT) % 18446744073709551616::HUGEINT AS v
        FROM hashed, range(4) AS r(k) GROUP BY ALL)
  GROUP BY ALL),
digits AS (
  SELECT doc_id, edited, k, count(*) AS n, sum(v >> 3) AS b0, sum((v >> 2) & 1) AS b1, sum((v >> 1) & 1) AS b2, sum(v & 1) AS b3
  FROM (SELECT doc_id, edited, k, strpos('0123456789abcdef', h[k + 1:k + 1]) - 1 AS v FROM hashed, range(64) AS r(k)) GROUP BY ALL),
signs AS (
  SELECT doc_id, edited, flatten(list(list_transform([b0, b1, b2, b3], lambda b: ((2 * b - n + 32768) % 65536 + 65536)::BIGINT % 65536 - 32768) ORDER BY k)) AS signs
  FROM digits GROUP BY ALL),
prints AS (
  SELECT doc_id, edited, coalesce(signs, list_transform(range(256), lambda i: 0)) AS signs,
         coalesce(words, repeat('0', 64)) || coalesce(array_to_string(list_transform(signs, lambda s: lpad(lower(to_hex((s + 65536) % 65536)), 4, '0')), ''), repeat('0', 1024)) AS print
  FROM bodies LEFT JOIN words USING (doc_id, edited) LEFT JOIN signs USING (doc_id, edited)),
own AS (
  SELECT *, coalesce(lead(signs) OVER (ORDER BY doc_id), first_value(signs) OVER (ORDER BY doc_id)) AS next_signs,
         coalesce(lead(print) OVER (ORDER BY doc_id), first_value(print) OVER (ORDER BY doc_id)) AS next_print
  FROM prints WHERE NOT edited),
sides AS (
  SELECT doc_id, own.print AS fingerprint, own.signs AS a, own.next_signs AS b, own.next_print, e.print AS edited_fingerprint, e.signs AS c
  FROM own JOIN (SELECT * FROM prints WHERE edited) e USING (doc_id)),
energies AS (
  SELECT *, list_sum(list_transform(a, lambda x: x * x)) AS ea, list_sum(list_transform(b, lambda x: x * x)) AS eb, list_sum(list_transform(c, lambda x: x * x)) AS ec,
         list_sum(list_transform(range(256), lambda i: pow(((a[i + 1] - b[i + 1] + 98304) % 65536) - 32768, 2)::BIGINT)) AS ab,
         list_sum(list_transform(range(256), lambda i: pow(((a[i + 1] - c[i + 1] + 98304) % 65536) - 32768, 2)::BIGINT)) AS ac
  FROM sides)
SELECT doc_id, length(text) AS n_chars, sha256(after) AS edited_sha256, fingerprint, edited_fingerprint,
       CASE WHEN fingerprint = edited_fingerprint THEN 1.0 WHEN ea + ec = 0 THEN 0.0 ELSE greatest(0.0, 1.0::DOUBLE - ac::DOUBLE / (ea + ec)::DOUBLE) END::DOUBLE AS near_edited,
       CASE WHEN fingerprint = next_print THEN 1.0 WHEN ea + eb = 0 THEN 0.0 ELSE greatest(0.0, 1.0::DOUBLE - ab::DOUBLE / (ea + eb)::DOUBLE) END::DOUBLE AS near_next
FROM changed JOIN energies USING (doc_id)
"""


@registered("op13_multiset_fingerprints", MULTISET_SQL)
def op13_multiset_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multiset_hash.edited_with_next(table(spark, sf_dir, "documents"))


def _crc_table() -> list[int]:
    """CRC-32 of every byte, from its polynomial."""
    table = []
    for value in range(256):
        for _ in range(8):
            value = value >> 1 ^ (0xEDB88320 if value & 1 else 0)
        table.append(value)
    return table


# Letters beyond ASCII as other single bytes, for an edit distance that counts bytes.
_ACCENTED = "".join(map(chr, range(0xC0, 0x100)))
_SINGLE = "".join(c for c in map(chr, range(33, 127)) if c not in "'" and not c.islower())[:64]

SPELLING_SQL = f"""
WITH RECURSIVE runs AS (
  SELECT doc_id, translate(w, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w, count(*) AS c
  FROM (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\\x{{00C0}}-\\x{{00FF}}]+')) AS w FROM documents) GROUP BY ALL),
coded AS (SELECT *, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || w)) AS h FROM runs),
summed AS (
  SELECT w, c, xor(4294967295::BIGINT, list_reduce(
           list_prepend(4294967295::BIGINT, list_transform(range(0, len(h) // 2), lambda i: ('0x' || h[2 * i + 1:2 * i + 2])::BIGINT)),
           lambda a, b: xor(a >> 8, {_crc_table()}[(xor(a, b) & 255) + 1]))) AS crc
  FROM coded),
lossy AS (SELECT CASE WHEN crc % 97 = 0 THEN left(w, crc % length(w)) || substr(w, crc % length(w) + 2) ELSE w END AS w, c FROM summed),
words AS MATERIALIZED (
  SELECT w, sum(c)::BIGINT AS n, translate(w, '{_ACCENTED}', '{_SINGLE}') AS b FROM lossy WHERE length(w) >= 5 GROUP BY w HAVING sum(c) >= 3),
pairs AS MATERIALIZED (
  SELECT x.w, x.n, y.w AS other, y.n AS m FROM words x JOIN words y ON left(x.b, 2) = left(y.b, 2) WHERE abs(length(x.b) - length(y.b)) <= 1 AND levenshtein(x.b, y.b) = 1
  UNION
  SELECT x.w, x.n, y.w, y.n FROM words x JOIN words y ON right(x.b, 2) = right(y.b, 2) WHERE abs(length(x.b) - length(y.b)) <= 1 AND levenshtein(x.b, y.b) = 1),
best AS (
  SELECT w, any_value(n) AS n, count(*) AS n_near, first(other ORDER BY m DESC, encode(other)) AS other, max(m) AS m FROM pairs GROUP BY w),
forms AS MATERIALIZED (SELECT w, other AS form, m AS form_n FROM best WHERE m >= 2 * n),
walk AS (
  SELECT w, form AS here FROM forms
  UNION ALL
  SELECT walk.w, forms.form FROM walk JOIN forms ON walk.here = forms.w),
roots AS (SELECT w, here AS root FROM walk WHERE here NOT IN (SELECT w FROM forms))
SELECT words.w AS word, form, coalesce(root, words.w) AS root, words.n, coalesce(n_near, 0) AS n_near, form_n
FROM words LEFT JOIN best USING (w) LEFT JOIN forms USING (w) LEFT JOIN roots USING (w)
"""


@registered("op12_spelling_variants", SPELLING_SQL)
def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variant_report(table(spark, sf_dir, "documents"))


registered("pipeline", corpus_pipeline.ORACLE_SQL)(corpus_pipeline.run)
