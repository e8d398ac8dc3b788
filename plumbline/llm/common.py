"""What the corpus operators share: the word rule, the shared folder, and small Column helpers."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are maximal runs of characters other than these six ASCII white-space characters.
SPACE_CLASS = r"[\x20\x09-\x0D]+"
SPACE_CHARS = " \t\n\x0b\x0c\r"

DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_list(text: Column) -> Column:
    """The words of a text in order; of null, none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE_CLASS), "")


def word_count(text: Column) -> Column:
    """The number of words as a long; of null, 0. Trimming first spares a filter over the array."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE_CHARS))
    return F.when(bare == "", F.lit(0)).otherwise(F.size(F.split(bare, SPACE_CLASS))).cast("long")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share. A local session without one (tests, a laptop) gets a temporary folder; on a
    cluster there is no other folder that all can see, so it must be set."""
    own = spark.conf.get("spark.checkpoint.dir", None)
    if own:
        return own.rstrip("/")
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="plumbline-"))
    return sc.getCheckpointDir().rstrip("/")


#: With this setting the shuffle files of a finished statement go at once, not when the driver collects its garbage.
#: It is set once and stays: each statement only loses its own files, at its own end.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, codec: str = "zstd") -> DataFrame:
    """df as a table written to the shared folder and read back: lineage ends here, and a lost executor costs the
    re-reading of a file. The table is removed when the session ends, or by forget()."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/plumbline/{uuid.uuid4().hex}"
    spark.conf.set(CLEANUP, "true")
    df.write.option("compression", codec).parquet(path)
    where, fs = _file_system(spark, path)
    fs.deleteOnExit(where)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def forget(table: DataFrame) -> None:
    """Removes a table of written() that nothing reads any more; other frames are left alone."""
    path = getattr(table, "_written_to", None)
    if path:
        remove(table.sparkSession, path)


def remove(spark: SparkSession, path: str) -> None:
    where, fs = _file_system(spark, path)
    fs.delete(where, True)


def _file_system(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def checkpointed(df: DataFrame) -> DataFrame:
    """An eager, reliable checkpoint in the shared folder; for the small frames of loops."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def fresh(*taken: str, base: str) -> str:
    """A column name that the table does not have yet."""
    name, low = base, {t.lower() for t in taken}
    while name.lower() in low:
        name += "_"
    return name
