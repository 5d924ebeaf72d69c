"""Words that end in marks share the ids of their stem, and the ids are the tokenizer's."""

import random

import pytest

pytest.importorskip("tokenizers")

from millrace.llm import packing  # noqa: E402


@pytest.fixture(scope="module")
def cache():
    return packing.WordCache(packing.default_tokenizer())


def test_a_stem_is_encoded_once(cache, monkeypatch):
    encoded = []
    for name in ("_encoded", "_merged"):
        plain = getattr(cache, name)
        monkeypatch.setattr(cache, name, lambda words, space, plain=plain: encoded.extend(words) or plain(words, space))
    cache.forget()
    text = "so stem stem. stem, stem!! stem###, stem). stem?"
    assert cache.encode([text]) == [cache.direct(text)]
    assert sorted(encoded) == ["so", "stem"]


def test_ids_are_those_of_the_whole_text(cache):
    rng = random.Random(4)
    parts = ["it", "it's", "'s", "é", "Straße", "ŁÓDŹ", "ʃ", "x1", "7", "²", "Ⅷ", "_", "e\u0301", "漢字", "<|endoftext|>", "<|endoftext", "|>", *packing.MARKS, "'", "’", "…", "!!", "%%%", ".,"]
    texts = [rng.choice(" \n").join("".join(rng.choice(parts) for _ in range(rng.randrange(1, 6))) for _ in range(rng.randrange(1, 30))) for _ in range(3000)]
    cache.forget()
    assert [cache.encode([t])[0] for t in texts] == [cache.direct(t) for t in texts]


def test_letters_are_merged_without_the_search_for_pieces(cache):
    assert cache.merges_alone
    letters = [chr(c) for c in range(0x250) if chr(c).isalpha()]
    rng = random.Random(5)
    words = [*letters, *("".join(rng.choice(letters) for _ in range(rng.randrange(2, 20))) for _ in range(2000))]
    assert all(map(packing.of_letters, words)) and not any(map(packing.of_letters, ["", "a1", "a.", "²", "×", "it's", "漢"]))
    for space in ("", " "):
        assert cache._merged(words, space) == [cache.direct(space + w) for w in words]
