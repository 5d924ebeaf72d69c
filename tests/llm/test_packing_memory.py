"""Words are remembered within a task only."""

import pytest

pytest.importorskip("tokenizers")

from pyspark.sql import functions as F  # noqa: E402

from millrace.llm import packing  # noqa: E402


def test_an_idle_worker_remembers_no_words(spark):
    tokenizer = packing.default_tokenizer()
    docs = spark.createDataFrame([(i, f"word{i} and another{i}, more") for i in range(50)], "doc_id long, text string").coalesce(1)
    assert packing.tokenised(docs, tokenizer).count() == 50

    def held(_):
        from millrace.llm import packing

        return [sum(len(c.first) + len(c.spaced) for c in packing._caches.values())]

    # The empty word of each cache at most, in whichever worker this runs.
    assert max(spark.sparkContext.parallelize(range(8), 8).mapPartitions(held).collect()) <= 1
    cache = packing.WordCache(tokenizer)
    before = cache.encode(["some words. other"])
    cache.forget()
    assert cache.encode(["some words. other"]) == before
