"""The fingerprint of a table is one SHA-256 over every name and digest."""

import hashlib
from collections import defaultdict

import pytest

duckdb = pytest.importorskip("duckdb")

from millrace.plans.catalog import QUERIES, SQL  # noqa: E402


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def plain(rows):
    """Lines sorted in buckets of the names' first three digits, then the buckets' digests."""
    buckets = defaultdict(list)
    for name, text in rows:
        if text is not None:
            buckets[sha(str(name))[:3]].append(f"{name}:{sha(text)}")
    return sha("\n".join(f"{b}:{sha(chr(10).join(sorted(buckets[b])))}" for b in sorted(buckets))) if buckets else None


@pytest.mark.parametrize("rows", [[(i, "é" * (i % 7) if i % 11 else None) for i in range(9000)], [(1, None)], []], ids=["many", "no text", "empty"])
def test_content_fingerprint_digests_every_line(spark, tmp_path, rows):
    path = str(tmp_path / "documents.parquet")
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(path)
    got = QUERIES["content_fingerprint"](spark, str(tmp_path)).first()
    assert tuple(got) == (plain(rows), len(rows) or None)
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}/*.parquet'")
    assert connection.execute(SQL["content_fingerprint"]).fetchall() == [tuple(got)]
