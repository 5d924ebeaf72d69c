"""Content digests, manifests and per-run directories."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.arrays import let

# Fixed value: the only licence an admissible source manifest may state.
ADMITTED_LICENSE = "CC-BY-4.0"


def file_contents(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """Files below a path as (name, content), the name relative to the path."""
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", glob)
        .load(path)
    )
    root = path.split("://")[-1].rstrip("/") + "/"
    return files.select(F.element_at(F.split(F.col("path"), F.lit(root)), -1).alias("name"), "content")


def content_digests(df: DataFrame, name: str = "name", content: str = "content") -> DataFrame:
    """SHA-256 and MD5 of each item's bytes."""
    data = F.col(content).cast("binary")
    return df.select(F.col(name).alias("name"), F.sha2(data, 256).alias("sha256"), F.md5(data).alias("md5"))


# Files above this many bytes are never one value of a row; a value holds two gigabytes at most.
CELL_BYTES = 512 * 1024 * 1024
_MARK = b"\xef\xbb\xbf"


def file_digests(spark: SparkSession, path: str, glob: str = "*", cell_bytes: int = CELL_BYTES) -> DataFrame:
    """SHA-256 and MD5 of every file below a path, of any size.

    Files up to ``cell_bytes`` are digested as one value. Larger ones are read
    by ranges as lines, and the lines of a file stream in order through one task
    that holds one at a time. A line must fit a value, and a large file's name
    must not make Spark decompress it.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob)
    files = reader.load(path)
    root = path.split("://")[-1].rstrip("/") + "/"
    name = F.element_at(F.split(F.col("path"), F.lit(root)), -1)
    small = content_digests(files.filter(F.col("length") <= cell_bytes).select(name.alias("name"), "content"))
    # Listing reads no contents; there are few files of such a size.
    large = [r.path for r in files.filter(F.col("length") > cell_bytes).select("path").collect()]
    if not large:
        return small
    lines = spark.read.option("lineSep", "\n").text(large).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("size"), F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("place"), F.col("value").cast("binary").alias("line"),
    )
    ordered = lines.repartition("path").sortWithinPartitions("path", "start", "place").select("path", "size", "line")
    digests = ordered.mapInArrow(_streamed_digests, "path string, sha256 string, md5 string")
    # Paths of rows are encoded as in a URI, where a plus stands for itself.
    plain = F.url_decode(F.replace(F.regexp_replace("path", "^file:/+", "/"), F.lit("+"), F.lit("%2B")))
    return small.unionByName(digests.select(F.element_at(F.split(plain, F.lit(root)), -1).alias("name"), "sha256", "md5"))


def _streamed_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of files whose lines come in order; line ends and a byte order mark are put back by the file's size."""

    class Running:
        def __init__(self, path: str, size: int):
            self.path, self.size, self.seen, self.held = path, size, 0, None
            # The reader drops a leading byte order mark; whether there was one shows at the end.
            self.hashes = [(hashlib.sha256(start), hashlib.md5(start)) for start in (b"", _MARK)]

        def add(self, data: bytes) -> None:
            for pair in self.hashes:
                for one in pair:
                    one.update(data)
            self.seen += len(data)

        def line(self, data: bytes) -> None:
            if self.held is not None:
                self.add(self.held + b"\n")
            self.held = data

        def row(self) -> pa.RecordBatch:
            self.add(self.held)
            left = self.size - self.seen
            marked = left >= len(_MARK)
            left -= len(_MARK) if marked else 0
            if left not in (0, 1):
                raise ValueError(f"{self.path}: {self.seen} bytes read of {self.size}")
            self.add(b"\n" * left)
            sha256, md5 = self.hashes[marked]
            return pa.RecordBatch.from_pydict({"path": [self.path], "sha256": [sha256.hexdigest()], "md5": [md5.hexdigest()]})

    running: Running | None = None
    for batch in batches:
        paths, sizes, lines = batch.columns
        for i in range(batch.num_rows):
            path = paths[i].as_py()
            if running is None or path != running.path:
                if running is not None:
                    yield running.row()
                running = Running(path, sizes[i].as_py())
            running.line(lines[i].as_py())
    if running is not None:
        yield running.row()


def digest_mismatches(expected: DataFrame, actual: DataFrame, column: str = "sha256") -> DataFrame:
    """Names whose expected digest is absent or different."""
    return expected.select("name", column).join(actual.select("name", column), ["name", column], "left_anti")


_WORDS, _WORD = 4, 1 << 32


def fingerprint(digests: DataFrame) -> DataFrame:
    """One digest for a whole set of named contents, independent of their order.

    Every (name, digest) is hashed to 128 bits, and the sum of all modulo 2^128
    is the fingerprint. Sums of parts add up, so partial sums are all that is
    shuffled, and items can be added or taken away later.
    """
    line = F.sha2(F.concat_ws(":", F.col("name"), F.col("sha256")).cast("binary"), 256)
    words = digests.select(*[F.conv(F.substring(line, 8 * k + 1, 8), 16, 10).cast("decimal(20,0)").alias(f"w{k}") for k in range(_WORDS)])
    sums = words.agg(*[F.coalesce(F.sum(f"w{k}"), F.lit(0)).cast("decimal(38,0)").alias(f"w{k}") for k in range(_WORDS)], F.count("*").alias("items"))
    # Carries go from the last word to the first.
    for k in reversed(range(_WORDS)):
        carry = F.call_function("div", F.col(f"w{k}"), F.lit(_WORD)).cast("decimal(38,0)")
        if k:
            sums = sums.withColumn(f"w{k - 1}", (F.col(f"w{k - 1}") + carry).cast("decimal(38,0)"))
        sums = sums.withColumn(f"w{k}", F.col(f"w{k}") % F.lit(_WORD))
    digits = [F.lpad(F.lower(F.hex(F.col(f"w{k}").cast("bigint"))), 8, "0") for k in range(_WORDS)]
    return sums.select(F.concat(*digits).alias("fingerprint"), "items")


def ordered_fingerprint(digests: DataFrame) -> DataFrame:
    """One SHA-256 for a whole set of named contents, over all of them in order of their names' buckets.

    Names are spread over 4,096 buckets by their own hash; the (name, digest)
    lines of a bucket are sorted and digested, and only those bucket digests
    meet at the end. An item without a digest is counted, but has no line.
    """
    def joined(lines):
        return let(lines, lambda found: F.when(F.size(found) > 0, F.sha2(F.concat_ws("\n", F.sort_array(found)).cast("binary"), 256)))

    bucket = F.substring(F.sha2(F.col("name").cast("binary"), 256), 1, 3)
    line = F.concat(F.col("name"), F.lit(":"), F.col("sha256"))
    buckets = digests.groupBy(bucket.alias("bucket")).agg(joined(F.collect_list(line)).alias("digest"), F.count("*").alias("items"))
    entry = F.concat(F.col("bucket"), F.lit(":"), F.col("digest"))
    return buckets.agg(joined(F.collect_list(entry)).alias("fingerprint"), F.sum("items").alias("items"))


def check_manifest(manifest: DataFrame) -> DataFrame:
    """Refuse source manifests that do not declare generated, licensed, non-customer data."""
    gates = {
        "synthetic and generated must be true": F.col("synthetic").eqNullSafe(True) & F.col("generated").eqNullSafe(True),
        "customer_data must be false": F.col("customer_data").eqNullSafe(False),
        f"data_license must be {ADMITTED_LICENSE}": F.col("data_license").eqNullSafe(ADMITTED_LICENSE),
    }
    failed = manifest.select(
        F.array_compact(F.array(*[F.when(~ok, F.lit(text)) for text, ok in gates.items()])).alias("failed")
    ).filter(F.size("failed") > 0)
    first = failed.first()
    if first is not None:
        raise ValueError(f"Source manifest refused: {first['failed']}")
    return manifest


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("multiLine", "true").json(path)


def manifest_runs(manifest: DataFrame) -> DataFrame:
    """Runs listed by a manifest, one row each."""
    return manifest.select(F.explode("runs").alias("_r")).select("_r.*")


def read_event_intervals(spark: SparkSession, path: str) -> DataFrame:
    """Event intervals, from ``{"events": [...]}`` documents or from JSON lines."""
    raw = spark.read.option("multiLine", "true").json(path)
    if "events" in raw.columns:
        return raw.select(F.explode("events").alias("_e")).select("_e.*")
    return spark.read.json(path)


def run_directories(spark: SparkSession, root: str, partitions: Sequence[str] = ("train", "validation", "test")) -> DataFrame:
    """Telemetry of ``{partition}/{run}/telemetry.parquet`` with both names taken from the path."""
    paths = [f"{root}/{p}/*/telemetry.parquet" for p in partitions]
    source = F.col("_metadata.file_path")
    pattern = r"([^/]+)/([^/]+)/telemetry\.parquet$"
    return spark.read.option("mergeSchema", "true").parquet(*paths).select(
        "*",
        F.regexp_extract(source, pattern, 1).alias("partition"),
        F.regexp_extract(source, pattern, 2).alias("run_directory"),
    )


def run_truths(spark: SparkSession, root: str, partitions: Sequence[str] = ("train", "validation", "test")) -> DataFrame:
    """Ground truth of each run directory: declared run and its events."""
    paths = [f"{root}/{p}/*/ground_truth.json" for p in partitions]
    source = F.col("_metadata.file_path")
    pattern = r"([^/]+)/([^/]+)/ground_truth\.json$"
    event = "array<struct<event_id:string,asset_id:string,type:string,start:string,end:string>>"
    return spark.read.schema(f"run_id string, events {event}").option("multiLine", "true").json(paths).select(
        F.regexp_extract(source, pattern, 1).alias("partition"),
        F.regexp_extract(source, pattern, 2).alias("run_directory"),
        F.col("run_id"),
        F.coalesce(F.col("events"), F.array().cast(event)).alias("events"),
    )


def verified_runs(spark: SparkSession, root: str) -> DataFrame:
    """Runs of a manifest joined to their truth, refusing absent files, wrong digests and wrong run names."""
    runs = manifest_runs(check_manifest(read_manifest(spark, f"{root}/dataset_manifest.json")))
    listed = runs.select("partition", "run_id", "telemetry_sha256")
    digests = file_digests(spark, root, "telemetry.parquet")
    expected = listed.select(
        F.concat_ws("/", "partition", "run_id", F.lit("telemetry.parquet")).alias("name"),
        F.col("telemetry_sha256").alias("sha256"),
    )
    wrong = digest_mismatches(expected, digests).first()
    if wrong is not None:
        raise ValueError(f"Telemetry digest mismatch or missing file: {wrong['name']}")
    names = sorted(r[0] for r in listed.select("partition").distinct().collect())
    truths = run_truths(spark, root, names)
    unnamed = truths.filter(F.col("run_id") != F.col("run_directory")).first()
    if unnamed is not None:
        raise ValueError(f"Ground truth names another run: {unnamed['run_directory']}")
    absent = listed.join(truths.select("partition", "run_id"), ["partition", "run_id"], "left_anti").first()
    if absent is not None:
        raise ValueError(f"Missing ground truth for {absent['partition']}/{absent['run_id']}")
    return listed.join(truths.select("partition", "run_id", "events"), ["partition", "run_id"]).withColumn(
        "has_events", F.size("events") > 0
    )
