"""Fill-in-middle order against a plain tokenisation, and its chunk memory."""

import hashlib
import random
import re

from millrace.llm import fill_in_middle as fim

TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def brute(doc_id, text):
    text = text or ""
    tokens = TOKEN.findall(text)
    draw = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(draw[i : i + 8], 16) for i in (0, 8, 16, 24))
    if not text or h3 % 100 >= 50 or re.search("<[PSM]>", text):
        return len(tokens), "plain", None, None, text
    low, high = sorted((h1 % (len(tokens) + 1), h2 % (len(tokens) + 1)))
    prefix, middle, suffix = ("".join(t) for t in (tokens[:low], tokens[low:high], tokens[high:]))
    spm = h4 % 100 < 80
    output = f"<S>{suffix}<P>{prefix}<M>{middle}" if spm else f"<P>{prefix}<S>{suffix}<M>{middle}"
    return len(tokens), "spm" if spm else "psm", len(prefix), len(middle), output


def odd_texts(count=400):
    rng = random.Random(3)
    words = ["a", "bé", "中文字", "x" * 30, "z" * 9000, "$1", "<P", "<S>" if rng.random() < 0.2 else "S>", " ", "\U0001f600"]
    spaces = [" ", "  ", "\n", "\t\n ", "\r\v\f"]
    shared = " ".join(rng.choice(words[:4]) + str(rng.randint(0, 99)) for _ in range(900))
    texts = [None, "", " ", "\n\t", "one", " one", "one ", "é" * 20000, " " * 20000, "a " * 9000, "<P> x y z"]
    for _ in range(count):
        text = "".join(rng.choice(words) if rng.random() < 0.6 else rng.choice(spaces) for _ in range(rng.randint(1, 60)))
        texts.append(text + shared + text[::2] if rng.random() < 0.2 else text)
    return texts


def test_chunks_cover_a_text_and_keep_characters_whole():
    for text in odd_texts(100):
        data = (text or "").encode()
        starts = fim.chunk_starts(data)
        assert starts[0] == 0 and starts[-1] == len(data) and starts == sorted(set(starts))
        assert all(b - a <= fim.MOST for a, b in zip(starts, starts[1:], strict=False))
        assert b"".join(data[a:b] for a, b in zip(starts, starts[1:], strict=False)).decode() == (text or "")


def test_every_cut_is_the_plain_one():
    memory = fim.ChunkMemory()
    for text in odd_texts(60):
        counted = fim.Counted((text or "").encode(), memory)
        ends = [0, *(m.end() for m in TOKEN.finditer(text or ""))]
        assert counted.tokens == len(ends) - 1
        step = max(1, len(ends) // 50)
        for k in {*range(0, len(ends), step), len(ends) - 1}:
            place = counted.cut(k)
            assert counted.characters_before(place) == ends[k]


def test_shared_chunks_are_counted_once_and_verified():
    rng = random.Random(5)
    passage = "".join(chr(rng.randint(97, 122)) if rng.random() < 0.8 else " " for _ in range(50_000)).encode()
    memory = fim.ChunkMemory()
    fim.Counted(passage, memory)
    first = memory.counted
    fim.Counted(b"another start " + passage, memory)
    # Only chunks around the new start differ.
    assert first > 20 and memory.counted - first <= 2
    chunk = b"some words here"
    memory.known[fim.xxhash.xxh3_64_intdigest(chunk)] = b"other content", fim.Summary(99, 99, True, True)
    assert memory.summary(chunk) == fim.summarise(chunk)


def test_a_full_memory_changes_no_result():
    texts = odd_texts(80)
    small, large = fim.ChunkMemory(0), fim.ChunkMemory()
    assert [fim.reorder(i, t, small) for i, t in enumerate(texts)] == [fim.reorder(i, t, large) for i, t in enumerate(texts)]


def test_rows_equal_brute_force_and_come_back(spark):
    rows = [(i, t, "kept") for i, t in enumerate(odd_texts())]
    rows += [(None, "no id here at all", "kept"), (7, rows[7][1], "kept")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, form string")
    made = fim.fill_in_middle(docs)
    assert made.columns == ["doc_id", "text", "n", "form", "prefix_chars", "middle_chars", "output"]
    from pyspark.sql import functions as F

    got = made.withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == brute(r.doc_id, r.text)
        assert r.back == (r.text or "")
    assert {"plain", "spm", "psm"} == {r.form for r in got}


def test_an_empty_table_gives_an_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert fim.middle_report(docs).collect() == []
