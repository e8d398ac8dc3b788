"""Exact dedup by a content sort, in DataFrame functions only.

Texts are normalised (A-Z lower-cased, null is empty) and range-partitioned by content: Spark samples the splitters. The key
of the splitters is bounded: the first characters, then the SHA-256 of the whole text, so that splitters of long
texts stay small on the driver. Within a partition the external sort places equal texts next to each
other, and each row is compared with its neighbour by all of its bytes; digests only order, they never decide. Of equal
texts one row stays: that of the smallest or the largest id (ties: the first row as read).

Hot groups: a digest that more than `limit` rows share gets salts, so splitters may cut it and its rows are sorted
in many tasks. Each task pre-aggregates its stretch of equal texts to one row; only these rows, at most SALTS
a digest, are compared again, by their full texts, across salts. The limit follows rows and partitions, so at most 65,536
digests are hot and their table, which is broadcast, has a proven bound. Texts are shuffled once.

Cases: a null text equals an empty one; a null id is smaller than every other but stays only if all ids of
its group are null; repeated rows are rows of the group, one of them stays; very long texts are compared whole; an empty
table gives an empty table; other columns are not read by classes() and pass through deduplicated().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import fresh, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Characters of a text that lead the sort key; bytes of texts for each partition of the sort.
LEAD, PART_BYTES = 32, 64_000_000
#: Hot digests at most, and tasks that the rows of one digest are dealt to at most.
HOT, SALTS = 65_536, 4_096


def normalised(text: Column) -> Column:
    """text with A-Z lower-cased and no other change; lower() says the same, and faster, if all is ASCII."""
    text = F.coalesce(text, F.lit(""))
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def _best(keep: str, id_: Column, row: Column) -> Column:
    """A struct whose minimum is the row that stays."""
    if keep not in ("smallest", "largest"):
        raise ValueError("keep is 'smallest' or 'largest'")
    return F.struct(id_.isNull().alias("none"), (id_ if keep == "smallest" else F.bitwise_not(id_)).alias("by"), row.alias("row"), id_.alias("id"))


def _grouped(docs: DataFrame, keep: str) -> DataFrame:
    """(row, doc_id, sha, best, n) of rows (row, doc_id, text): the row that stays and the size of the group."""
    base = docs.select("row", F.col("doc_id").cast("long").alias("doc_id"), normalised(F.col("text")).alias("norm"))
    table = written(base.withColumns({"sha": F.sha2("norm", 256), "bytes": F.octet_length("norm")}))
    total = table.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes")).first()
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total["bytes"] // PART_BYTES))
    limit = max(100, -(-total["rows"] // min(2 * parts, HOT)))
    hot = table.groupBy("sha").agg(F.count(F.lit(1)).alias("copies")).filter(F.col("copies") > limit)
    hot = written(hot.select("sha", F.least(F.col("copies") / limit + 1, F.lit(SALTS)).cast("int").alias("salts")))
    salt = F.coalesce(F.pmod(F.xxhash64("row"), F.col("salts")).cast("int"), F.lit(-1))  # -1: not hot
    keyed = table.join(F.broadcast(hot), "sha", "left").select("row", "doc_id", "norm", "sha", salt.alias("salt"), F.left("norm", F.lit(LEAD)).alias("lead"))
    # the range exchange also clusters by its key, so neither window shuffles again
    dealt = keyed.repartitionByRange(parts, "lead", "sha", "salt")
    key = ["lead", "sha", "salt"]
    near = W.partitionBy(*key).orderBy("norm", "row")
    begins = F.when(F.col("norm") == F.lag("norm").over(near), 0).otherwise(1)
    compared = dealt.withColumn("begins", begins).withColumn("run", F.sum("begins").over(near))
    slim = compared.select(*key, "run", "row", "doc_id", F.when((F.col("salt") >= 0) & (F.col("begins") == 1), F.col("norm")).alias("norm"))
    own = W.partitionBy(*key, "run")
    runs = slim.withColumns({"best": F.min(_best(keep, F.col("doc_id"), F.col("row"))).over(own), "n": F.count(F.lit(1)).over(own)})
    runs = written(runs.drop("lead"))
    # stretches of hot digests, one row each, meet by their full texts
    same = W.partitionBy("sha", "norm")
    across = runs.filter((F.col("salt") >= 0) & F.col("norm").isNotNull())
    across = across.select("sha", "salt", "run", F.min("best").over(same).alias("best_"), F.sum("n").over(same).alias("n_"))
    runs = runs.drop("norm").join(F.broadcast(across), ["sha", "salt", "run"], "left")
    return runs.select("row", "doc_id", "sha", F.coalesce("best_", "best").alias("best"), F.coalesce("n_", "n").alias("n"))


def classes(docs: DataFrame, keep: str = "smallest") -> DataFrame:
    """doc_id, keep_id (id of the row that stays), group_size, kept, text_sha256 (of the normalised text) of every row."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    own = F.col("best.row") == F.col("row")
    return _grouped(rows, keep).select("doc_id", F.col("best.id").alias("keep_id"), F.col("n").alias("group_size"), own.alias("kept"), F.col("sha").alias("text_sha256"))


def deduplicated(docs: DataFrame, keep: str = "smallest") -> DataFrame:
    """The rows of docs that stay, with all their columns."""
    row = fresh(*docs.columns, base="_row")
    table = written(docs.withColumn(row, F.monotonically_increasing_id()))
    grouped = _grouped(table.select(F.col(row).alias("row"), "doc_id", "text"), keep)
    stay = grouped.filter(F.col("best.row") == F.col("row")).select(F.col("row").alias(row))
    return table.join(stay, row, "left_semi").select(*docs.columns)
