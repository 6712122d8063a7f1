"""What the corpus operators share: staging tables, shipping the package to workers, bounded batches."""

from __future__ import annotations

import gc
import os
import re
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Text bytes that a Python worker holds at once (one document may exceed it), and rows that Spark sends it at once.
BATCH_BYTES = 4 << 20
ARROW_ROWS = 1000
#: With this Spark deletes a query's shuffle files as the query ends; a table that is written needs them no more.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_root(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where that is unset, a temporary one on one machine, an error on a cluster."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="pactlens-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


class Stage:
    """Tables of one operator run, written to the shared folder so that lost executors cost no recomputation."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path = spark, f"{shared_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"

    def at(self, name: str) -> str:
        return f"{self.path}/{name}"

    def table(self, df: DataFrame, name: str) -> DataFrame:
        before = self.spark.conf.get(CLEANUP, "false")
        self.spark.conf.set(CLEANUP, "true")
        try:
            df.write.option("compression", "zstd").parquet(self.at(name))
        finally:
            self.spark.conf.set(CLEANUP, before)
        return self.spark.read.schema(df.schema).parquet(self.at(name))

    def drop(self, *names: str) -> None:
        """Remove tables that nothing lazy reads any more."""
        jvm = self.spark.sparkContext._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(self.at(name))
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    def free(self) -> None:
        """Let the driver find plans that are no longer in use, so that Spark deletes their shuffle files now and not at some later time."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()


def ship(spark: SparkSession) -> None:
    """Make this package importable on every executor, also where it is not installed, and keep Arrow batches small."""
    sc = spark.sparkContext
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(rows, min(ARROW_ROWS, int(spark.conf.get(rows, "10000")) or ARROW_ROWS))
    if getattr(sc, "_pactlens_shipped", False):
        return
    top = Path(__file__).resolve().parents[2]
    target = os.path.join(tempfile.mkdtemp(prefix="pactlens-zip-"), "pactlens_src.zip")
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted((top / "pactlens").rglob("*.py")):
            z.write(p, p.relative_to(top).as_posix())
    sc.addPyFile(target)
    sc._pactlens_shipped = True


def by_bytes(batches: Iterator[pa.RecordBatch], column: str, limit: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of at most `limit` bytes of `column`, one row at least."""
    import numpy as np
    import pyarrow.compute as pc

    for b in batches:
        if not b.num_rows:
            continue
        size = np.cumsum(pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False).astype("int64"))
        at = done = 0
        while at < b.num_rows:
            to = max(at + 1, int(np.searchsorted(size, done + limit, "right")))
            yield b.slice(at, to - at)
            at, done = to, int(size[to - 1])


def strings(column: pa.Array) -> list[str]:
    """Python strings; null becomes the empty text."""
    return [x or "" for x in column.to_pylist()]


def field_ddl(df: DataFrame, *names: str) -> str:
    return ", ".join(f"`{n}` {df.schema[n].dataType.simpleString()}" for n in names)


_SPACES = [chr(c) for c in (*range(9, 14), *range(28, 33))]
_WIDE = [chr(c) for c in (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]
#: A space beside white space: there a cut before the space would change the pre-tokens.
_BESIDE = list(dict.fromkeys([c + " " for c in _SPACES] + [" " + c for c in _SPACES]))
_CUT = re.compile(r"(?<=\S) (?=\S)")
#: Marks a piece that no space precedes; a lone surrogate is in no valid text.
_FIRST = "\ud800"


def pieces(text: str) -> list[str]:
    """The text in parts that a pre-tokenizer which puts a space before a word into its match splits alike, alone or together.

    No match runs over such a space, so the text may be cut before each space between two visible characters. That space is left
    out; whole() gives a part with it.
    """
    wide = not text.isascii() and any(c in text for c in _WIDE)
    out = _CUT.split(text) if wide or any(x in text for x in _BESIDE) else text.split(" ")
    out[0] = _FIRST + out[0]
    return out


def whole(piece: str) -> str:
    return piece[1:] if piece[:1] == _FIRST else " " + piece


def write_blobs(df: DataFrame, path: str, *, end: str) -> None:
    """Each row's first column, binary, becomes a file of its own under `path`, in any store that Spark writes.

    Spark has no sink for bytes, but its text sink writes a string's bytes as they are and, after each, the separator. `end` is that
    separator, in Latin-1; a file format must allow it as its last bytes.
    """
    (column,) = df.columns
    df.select(df[column].cast("string").alias("value")).write.option("maxRecordsPerFile", 1).option("lineSep", end).option("encoding", "ISO-8859-1").text(path)


def read_blobs(spark: SparkSession, path: str) -> DataFrame:
    """path and content of every file that write_blobs wrote; a task gets whole files, so they should be of a bounded size."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")
