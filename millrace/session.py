"""Session defaults, shared scratch space and lineage cuts."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Time arithmetic in this package assumes UTC, and strict casts rely on ANSI mode.
REQUIRED_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}

# Settings that only a session's builder can give. Recording the Python call
# site of every expression costs milliseconds each.
BUILDER_SETTINGS = {"spark.python.sql.dataFrameDebugging.enabled": "false"}

# A setting of Spark 4.1; others do not know it and keep shuffle files longer.
SHUFFLES_DROPPED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_fallback_dir: str | None = None
_open_scopes: list[list[str]] = []


def prepare_session(spark: SparkSession) -> SparkSession:
    """Apply the settings every operator relies on to an existing session."""
    for key, value in REQUIRED_SETTINGS.items():
        if spark.conf.get(key, None) != value and spark.conf.isModifiable(key):
            spark.conf.set(key, value)
    return spark


def local_session(cores: int | str = 8, app: str = "millrace", memory: str = "12g") -> SparkSession:
    """A single-machine session for tests and benchmarks."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in {**REQUIRED_SETTINGS, **BUILDER_SETTINGS}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return prepare_session(spark)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach, as the cluster names it.

    Only when the cluster names none and driver and tasks share one machine is
    a temporary folder made, once per process; elsewhere executors could not
    see it, so the job is refused.
    """
    global _fallback_dir
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    master = spark.conf.get("spark.master", "local")
    if not re.fullmatch(r"local(\[[^\]]*\])?", master):
        raise ValueError(f"spark.checkpoint.dir must name a shared folder on {master}")
    if _fallback_dir is None:
        _fallback_dir = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return _fallback_dir


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path under the shared folder."""
    path = os.path.join(shared_dir(spark), "millrace", f"{label}-{uuid.uuid4().hex}")
    for scope in _open_scopes:
        scope.append(path)
    return path


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[list[str]]:
    """Remove the intermediate tables made inside the block when it ends, but for those made ``outliving`` it.

    Results are lazy, so write or collect them before leaving the block.
    """
    made: list[str] = []
    _open_scopes.append(made)
    try:
        yield made
    finally:
        # By identity: scopes with the same tables are equal as lists.
        _open_scopes[:] = [scope for scope in _open_scopes if scope is not made]
        for path in made:
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


@contextmanager
def outliving(scope: list[str]) -> Iterator[None]:
    """Tables made inside the block stay when ``scope``, or one inside it, ends; scopes around it still remove them."""
    at = next(i for i, each in enumerate(_open_scopes) if each is scope)
    inner = _open_scopes[at:]
    del _open_scopes[at:]
    try:
        yield
    finally:
        _open_scopes[at:] = inner


@contextmanager
def _shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Remove a query's shuffle files when it ends; else they stay until the driver happens to collect garbage."""
    before = spark.conf.get(SHUFFLES_DROPPED, None)
    spark.conf.set(SHUFFLES_DROPPED, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(SHUFFLES_DROPPED)
        else:
            spark.conf.set(SHUFFLES_DROPPED, before)


def settle(df: DataFrame, label: str = "stage") -> DataFrame:
    """Write an intermediate table to the shared folder and read it back.

    This cuts lineage (a lost executor costs a re-read, not a re-run), computes
    the table once however many readers follow, and lets them prune columns.
    The shuffles behind it go at once.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    with _shuffles_dropped(spark):
        df.write.mode("errorifexists").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
