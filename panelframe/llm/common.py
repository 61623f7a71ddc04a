"""Shared folder, staged tables and Arrow batching for the text operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Bytes of text laid end to end for one round of numpy calls.
LAID_BYTES = 1 << 19


#: With this setting a query's shuffle files go when it ends, not when the driver happens to collect garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. A local session without one gets a folder of its own; a cluster must name it."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="shared-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


@contextmanager
def _shuffles_end_with_their_query(spark: SparkSession) -> Iterator[None]:
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def _place(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Writes df as a table in the shared folder and reads it back: lineage ends here, and a lost
    executor costs a reread instead of the work before."""
    spark = df.sparkSession
    path = _place(spark, name)
    with _shuffles_end_with_their_query(spark):
        df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_path = path
    return out


def bucketed(df: DataFrame, key: str, n: int, name: str) -> DataFrame:
    """Like staged, dealt by key into n buckets: grouping the table by key needs no further shuffle."""
    spark = df.sparkSession
    path = _place(spark, name)
    table = path.rsplit("/", 1)[1].replace("-", "_")
    with _shuffles_end_with_their_query(spark):
        df.repartition(n, key).write.bucketBy(n, key).option("path", path).option("compression", "zstd").format("parquet").saveAsTable(table)
    return spark.table(table)


def discard(*frames: DataFrame) -> None:
    """Deletes tables made by staged() that nothing reads any more."""
    for df in frames:
        spark, jvm = df.sparkSession, df.sparkSession.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(df.staged_path)
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def shuffle_partitions(spark: SparkSession) -> int:
    """The session's sizing knob; a cluster sets it to the input's size."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def byte_texts(column: pa.Array) -> list[bytes | None]:
    return column.cast(pa.large_binary()).to_pylist()


def blocks(texts: list, most: int = LAID_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about `most` bytes of text; a longer text has a range of its own."""
    first, total = 0, 0
    for i, text in enumerate(texts):
        n = len(text or b"") + 1
        if total and total + n > most:
            yield first, i
            first, total = i, 0
        total += n
    if first < len(texts):
        yield first, len(texts)


def laid(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """The texts' bytes with a newline after each, and where each text starts (with the end last)."""
    joined = b"\n".join(t or b"" for t in texts) + b"\n"
    at = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t or b"") + 1 for t in texts], out=at[1:])
    return np.frombuffer(joined, np.uint8), at


def per_doc(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of values between consecutive positions of at."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return np.diff(total[at])


def covered(starts: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    """Which of n positions lie inside any [start, end)."""
    depth = np.zeros(n + 1, np.int64)
    np.add.at(depth, starts, 1)
    np.add.at(depth, ends, -1)
    return np.cumsum(depth[:-1]) > 0
