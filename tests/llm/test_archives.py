"""Archives are bounded by bytes and by records, and read back whole."""

import gzip

import pytest
from millrace.llm import archives


def contents(folder):
    return [gzip.decompress(p.read_bytes()) for p in sorted(folder.glob("part-*"))]


@pytest.mark.parametrize(("archive_bytes", "records"), [(9_000, 100), (10**9, 4), (1, 100), (archives.ARCHIVE_BYTES, archives.RECORDS_PER_ARCHIVE)])
def test_archives_of_bounded_size(spark, tmp_path, archive_bytes, records):
    bodies = {i: f"<p>{i}</p>\n\n" + "word é\n" * (i % 7 * 100) for i in range(60)}
    bodies[60], bodies[61] = bodies[59], ""
    pages = spark.createDataFrame([(i, f"http://h/{i}", b) for i, b in bodies.items()], "page_id long, url string, html string").repartition(3)
    arc = archives.write_arc(pages, str(tmp_path / "arc"), records=records, archive_bytes=archive_bytes)
    warc = archives.convert(spark, arc, str(tmp_path / "warc"), records, archive_bytes)
    largest = max(len(b.encode()) for b in bodies.values()) + 2_000
    for folder, parse in ((tmp_path / "arc", archives.parse_arc), (tmp_path / "warc", archives.parse_warc)):
        for data in contents(folder):
            assert len(data) <= archive_bytes + largest
            assert len(list(parse(data))) <= records + 1
    read = {r.page_id: r for r in archives.read_warc(spark, warc, with_payload=True).collect()}
    assert set(read) == set(bodies)
    for i, r in read.items():
        assert r.record_type == ("revisit" if i == 59 else "response") and r.payload_bytes == len(bodies[i].encode())
        assert r.record_type == "revisit" or bytes(r.payload).decode() == bodies[i]


def test_long_records_are_lines_of_their_own(monkeypatch):
    monkeypatch.setattr(archives, "_LINE_BYTES", 50)
    lines = archives.ArchiveLines(10**6, 10**6)
    out = [b for i in range(130) for batch in lines.add(b"x" * (5 + i % 3 * 30) + b"\n") for b in batch.column(0).to_pylist()]
    out += [b for batch in lines.give() for b in batch.column(0).to_pylist()]
    assert b"".join(v + b"\n" for v in out) == b"".join(b"x" * (5 + i % 3 * 30) + b"\n" for i in range(130))
    assert max(map(len, out)) < 50 + 66 and lines.lines == len(out) % archives._LINES


def test_ids_that_are_no_integers(spark, tmp_path):
    pages = spark.createDataFrame([("a", "http://h/", "x")], "page_id string, url string, html string")
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        archives.write_arc(pages, str(tmp_path / "arc"))
    assert [archives._number(v) for v in (None, "", "12", "-3", "a1", str(2**63), str(2**63 - 1))] == [None, None, 12, -3, None, None, 2**63 - 1]
