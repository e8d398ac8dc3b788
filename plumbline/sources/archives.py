"""ZIP archives as a table of entries: the directories first, then the contents in blocks of many tasks."""

from __future__ import annotations

import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from plumbline.operators.graph import checkpointed

#: Bytes of contents that a task gathers before it hands them on.
BATCH_BYTES = 32 << 20
#: Most tasks that read contents at once.
MAX_TASKS = 50_000
DAMAGED = (zipfile.BadZipFile, zlib.error, EOFError, NotImplementedError, RuntimeError, OSError, ValueError)


def _open(uri: str) -> zipfile.ZipFile:
    """An archive of any file system that pyarrow knows; only what is asked for is read."""
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri.removeprefix("file:")
    system, path = fs.FileSystem.from_uri(uri)
    return zipfile.ZipFile(system.open_input_file(path))


def directory(spark: SparkSession, path: str, max_entries: int = 100_000, max_bytes: int = 1 << 30) -> DataFrame:
    """(archive, ordinal, path, size_bytes, before, problem) of the entries of ZIP files that are no directories; contents are not
    read. `before` is the declared size of the entries before it. problem is `path` (not safe to unpack), `case` (an earlier entry
    differs only in case, or not at all), `limit` (the archive is over max_entries or max_bytes from here on), or null; an archive
    that cannot be read is one row without path, `damaged`; the scan skips files of no bytes, so they give no row. A task holds the directory of one archive; max_entries + 1 of its
    entries are kept, so the windows over an archive are bounded. The result is checkpointed, as contents() reads it twice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive in batch.column(0).to_pylist():
                try:
                    with _open(archive) as z:
                        rows = [(i, x.filename, x.file_size) for i, x in enumerate(z.infolist()) if not x.is_dir()][: max_entries + 1]
                except DAMAGED:
                    rows = [(None, None, None)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([archive] * len(rows), pa.string()), *(pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.string(), pa.int64())))],
                    names=["archive", "ordinal", "path", "size_bytes"],
                )

    names = spark.read.format("binaryFile").load(path).select("path")
    rows = names.mapInArrow(run, "archive string, ordinal long, path string, size_bytes long")
    parts = F.split(F.replace("path", F.lit("\\"), F.lit("/")), "/")
    unsafe = F.col("path").startswith("/") | F.array_contains(parts, "..") | F.get(parts, 0).contains(":")
    order = W.partitionBy("archive").orderBy("ordinal")
    again = F.row_number().over(W.partitionBy("archive", F.lower("path")).orderBy("ordinal")) > 1
    total, place = F.sum("size_bytes").over(order), F.row_number().over(order)
    problem = F.when(F.col("path").isNull(), "damaged").when(unsafe, "path").when(again, "case").when((total > max_bytes) | (place > max_entries), "limit")
    return checkpointed(rows.select("*", (total - F.col("size_bytes")).alias("before"), problem.alias("problem")))


def contents(entries: DataFrame, block_bytes: int = 64 << 20) -> DataFrame:
    """(archive, path, size_bytes, content, problem) of the entries of directory(). Those without a problem are read in blocks of about
    block_bytes, so a large archive is read by many tasks; one that does not unpack to its declared size and checksum has the
    problem `damaged` and no content, and the others are read all the same."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, z, infos, out, held = None, None, [], [], 0

        def batch_of(rows: list) -> pa.RecordBatch:
            types = (pa.string(), pa.string(), pa.int64(), pa.binary(), pa.string())
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=["archive", "path", "size_bytes", "content", "problem"])

        for batch in batches:
            for archive, ordinal, path, size in zip(*[batch.column(c).to_pylist() for c in ("archive", "ordinal", "path", "size_bytes")], strict=True):
                data = None
                try:
                    if archive != now:
                        if z is not None:
                            z.close()
                        now, z, infos = archive, None, []
                        z = _open(archive)
                        infos = z.infolist()
                    if z is not None:
                        data = z.read(infos[ordinal])
                except DAMAGED:
                    data = None
                sound = data is not None and len(data) == size
                out.append((archive, path, size, data if sound else None, None if sound else "damaged"))
                held += len(data) if sound else 0
                if held >= BATCH_BYTES or len(out) >= 10_000:
                    yield batch_of(out)
                    out, held = [], 0
        if out:
            yield batch_of(out)
        if z is not None:
            z.close()

    sound = entries.filter("problem is null").withColumn("_block", F.floor(F.col("before") / block_bytes))
    blocks = sound.select("archive", "_block").distinct().count()
    dealt = sound.repartitionByRange(max(1, min(blocks, MAX_TASKS)), "archive", "_block").sortWithinPartitions("archive", "ordinal")
    read = dealt.select("archive", "ordinal", "path", "size_bytes").mapInArrow(run, "archive string, path string, size_bytes long, content binary, problem string")
    refused = entries.filter("problem is not null")
    return read.unionByName(refused.select("archive", "path", "size_bytes", F.lit(None).cast("binary").alias("content"), "problem"))
