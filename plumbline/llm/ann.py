"""Nearest neighbours by cosine with randomly rotated one-bit codes.

Unit vectors are rotated by a fixed random orthogonal matrix; a candidate keeps the signs of its components
(packed into 64-bit words) and one correction scalar, the inner product f of its code with itself before coding.
A query keeps its rotated components in 8 bit planes. The inner product of code and query is then a sum of
bit counts of (word AND plane); divided by f it estimates the cosine, with an error of at most
`epsilon` * sqrt((1 - f^2) / f^2 / (D - 1)) with high probability, plus the rounding of the planes. Vectors whose upper
bound reaches the k-th best exact cosine so far are reranked exactly, in double precision on the original vectors.

Every row is indexed, that is coded once and written with its scalar, and every query sees every row's code: data rows go to
hash blocks, queries to blocks of `query_block`, and each pair of blocks is a cell, one partition, that streams its rows, so memory is bounded by a query block
and a batch. Cells return k rows a query; a window keeps the best k. Among equal vectors only the k + 1 smallest
ids of a batch can be in a result, so a vector that is everywhere costs no more than others.

Rows are numbered before they are indexed: a query's own row is no candidate, but other rows of its id are, and rows that
share an id are found and asked apart. Vectors of different dimensions have no cosine, so each dimension is searched by itself:
it is part of the cell.

Cases: vectors that are null, zero, or hold null or non-finite components take no part; components of any size are scaled
exactly; equal cosines go to the smaller id, then to the first row as read; rows with a null id take no part; repeated rows are
rows of their own; fewer than k candidates are all returned; an empty table gives an empty table; extra columns are
not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from .common import written

PLANES = 8


@lru_cache(maxsize=4)
def rotation(dim: int, seed: int = 7) -> np.ndarray:
    """A random orthogonal matrix of the least multiple of 64 that holds dim."""
    n = -(-dim // 64) * 64
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((n, n)))
    return q * np.sign(np.diag(r))


def rotated(vectors: np.ndarray, turn: np.ndarray) -> np.ndarray:
    unit = vectors / np.sqrt((vectors * vectors).sum(1, keepdims=True))
    return unit @ turn[: vectors.shape[1]]


def encode(vectors: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code words (n, words) and correction scalars f."""
    x = rotated(vectors, turn)
    words = np.packbits(x > 0, axis=1, bitorder="little").view(np.uint64)
    return words, np.abs(x).sum(1) / np.sqrt(len(turn))


class Query:
    """A query's bit planes."""

    def __init__(self, vector: np.ndarray, turn: np.ndarray):
        x = rotated(vector[None, :], turn)[0]
        self.low, span = float(x.min()), float(x.max() - x.min())
        self.step = span / (2**PLANES - 1) or 1.0
        level = np.rint((x - self.low) / self.step).astype(np.uint64)
        planes = [(level >> np.uint64(j)) & np.uint64(1) for j in range(PLANES)]
        self.planes = [np.packbits(p.astype(bool), bitorder="little").view(np.uint64) for p in planes]
        self.total = self.low * len(x) + self.step * float(level.sum())
        self.rounding = self.step / 2 * np.sqrt(len(x))

    def estimate(self, words: np.ndarray, ones: np.ndarray, f: np.ndarray) -> np.ndarray:
        dot = np.zeros(len(words))
        for j, plane in enumerate(self.planes):
            dot += np.bitwise_count(words & plane).sum(1, dtype=np.int64) * (1 << j)
        inside = self.low * ones + self.step * dot
        return (2 * inside - self.total) / np.sqrt(64 * words.shape[1]) / f


def cosines(vectors: np.ndarray, vector: np.ndarray) -> np.ndarray:
    """Cosines in double precision; sums run over components in order."""
    add = lambda x: np.add.accumulate(x, axis=1)[:, -1]
    return add(vectors * vector) / (np.sqrt(add(vectors * vectors)) * np.sqrt(add((vector * vector)[None, :])))


def distinct_rows(ids: np.ndarray, rows: np.ndarray, vectors: np.ndarray, k: int) -> np.ndarray:
    """Which rows to keep: of equal vectors the k + 1 smallest ids, then rows."""
    _, group = np.unique(np.ascontiguousarray(vectors).view(f"V{vectors.shape[1] * vectors.itemsize}").ravel(), return_inverse=True)
    order = np.lexsort((rows, ids, group))
    first = np.append(True, group[order][1:] != group[order][:-1])
    place = np.arange(len(ids)) - np.maximum.accumulate(np.where(first, np.arange(len(ids)), 0))
    return order[place <= k]


class Cell:
    """The best k candidates so far of each query of a block: score, id and row of each."""

    def __init__(self, k: int, dim: int, epsilon: float):
        self.k, self.turn, self.epsilon = k, rotation(dim), epsilon
        self.ids, self.rows, self.vectors, self.queries, self.best = [], [], [], [], []

    def add_queries(self, ids: np.ndarray, rows: np.ndarray, vectors: np.ndarray) -> None:
        self.ids += ids.tolist()
        self.rows += rows.tolist()
        self.vectors += list(vectors)
        self.queries += [Query(v, self.turn) for v in vectors]
        self.best += [(np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(ids)

    def add_rows(self, ids: np.ndarray, rows: np.ndarray, vectors: np.ndarray, words: np.ndarray, f: np.ndarray) -> None:
        keep = distinct_rows(ids, rows, vectors, self.k)
        ids, rows, vectors, words, f = ids[keep], rows[keep], vectors[keep], words[keep], f[keep]
        ones = np.bitwise_count(words).sum(1, dtype=np.int64)
        error = self.epsilon * np.sqrt(np.maximum(1 - f * f, 0) / (f * f) / (len(self.turn) - 1))
        for i, query in enumerate(self.queries):
            guess = query.estimate(words, ones, f)
            upper = guess + error + query.rounding / f
            m = min(len(ids), 4 * self.k + 1)
            near = np.argpartition(-guess, m - 1)[:m]
            best = self._merge(i, self.best[i], ids[near], rows[near], vectors[near])
            least = best[0][-1] if len(best[0]) == self.k else -np.inf
            more = np.flatnonzero(upper >= least)
            more = more[~np.isin(more, near)]
            self.best[i] = self._merge(i, best, ids[more], rows[more], vectors[more])

    def _merge(self, i: int, best: tuple, ids: np.ndarray, rows: np.ndarray, vectors: np.ndarray) -> tuple:
        other = rows != self.rows[i]
        if not other.any():
            return best
        score, own, row = np.append(best[0], cosines(vectors[other], self.vectors[i])), np.append(best[1], ids[other]), np.append(best[2], rows[other])
        order = np.lexsort((row, own, -score))[: self.k]
        return score[order], own[order], row[order]


def scaled(vectors: np.ndarray) -> np.ndarray:
    """vectors in double precision, each times the power of two that brings its largest component to about 1. This is exact
    and changes no cosine, but sums of squares neither over- nor underflow."""
    vectors = vectors.astype(np.float64)
    return np.ldexp(vectors, -np.frexp(np.abs(vectors).max(1))[1][:, None])


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy().reshape(-1, dim)


def indexed(rows: DataFrame) -> DataFrame:
    """rows (row, id, v, q, dim) with their codes (binary) and correction scalars f: the index, coded once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column(4).to_numpy()
            for dim in np.unique(dims).tolist():
                part = batch.filter(pa.array(dims == dim))
                words, f = encode(scaled(_matrix(part.column(2), dim)), rotation(dim))
                size = words.shape[1] * 8
                codes = pa.Array.from_buffers(pa.binary(), len(part), [None, pa.py_buffer((np.arange(len(part) + 1) * size).astype(np.int32).tobytes()), pa.py_buffer(words.tobytes())])
                yield pa.record_batch([*part.columns, codes, pa.array(f)], names=["row", "id", "v", "q", "dim", "code", "f"])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("code", T.BinaryType()), T.StructField("f", T.DoubleType())]))


def usable(vector: Column) -> Column:
    """True for vectors that take part."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def search(
    vectors: DataFrame,
    is_query: Column,
    k: int = 5,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    epsilon: float = 2.5,
    query_block: int = 4_096,
    data_block: int = 20_000,
) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each query row, nearest first."""
    # 4-byte components stay such, which halves what is shuffled; sums are made of 8-byte ones
    kind = vectors.schema[vector_column].dataType
    v = F.col(vector_column) if getattr(kind, "elementType", None) == T.FloatType() else F.col(vector_column).cast("array<double>")
    rows = vectors.select(F.monotonically_increasing_id().alias("row"), F.col(id_column).cast("long").alias("id"), v.alias("v"), is_query.alias("q"), F.size(v).alias("dim"))
    rows = written(indexed(rows.filter(F.col("id").isNotNull() & usable(F.col("v")))))
    schema = "query_row long, query_id long, vec_id long, vec_row long, score double"
    # one row a dimension: how many blocks its rows and queries are dealt to
    least = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    up = lambda a, n: F.greatest(F.lit(1), F.ceil(a / n)).cast("int")
    sizes = rows.groupBy("dim").agg(F.count(F.lit(1)).alias("n"), F.count_if("q").alias("asked"))
    sizes = sizes.select("dim", F.greatest(up(F.col("n"), data_block), F.least(F.lit(least), up(F.col("n"), 500))).alias("blocks"), up(F.col("asked"), query_block).alias("groups"))
    sizes = written(sizes)
    cells_of_all = sizes.agg(F.sum(F.col("blocks") * F.col("groups"))).first()[0] or 1
    # each query goes to all data blocks, each row to all query blocks
    side = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    of = lambda salt, n: F.pmod(F.xxhash64("row", F.lit(salt)), F.col(n)).cast("int")
    sized = rows.join(sizes, "dim")
    keep = ("dim", "blocks", "row", "id", "v", "code", "f")
    asked = sized.filter("q").select(of(1, "groups").alias("g"), side("blocks").alias("b"), F.lit(0).alias("kind"), *keep)
    data = sized.select(side("groups").alias("g"), of(2, "blocks").alias("b"), F.lit(1).alias("kind"), *keep)
    cells = asked.union(data).select((F.col("g") * F.col("blocks") + F.col("b")).cast("long").alias("cell"), "kind", "dim", "row", "id", "v", "code", "f")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, now = None, None

        def result(c: Cell) -> pa.RecordBatch:
            size = [len(best[0]) for best in c.best]
            flat = [np.concatenate([best[i] for best in c.best]) if c.best else np.zeros(0) for i in range(3)]
            asked = [np.repeat(np.array(x, np.int64), size) for x in (c.rows, c.ids)]
            columns = [*asked, flat[1].astype(np.int64), flat[2].astype(np.int64), flat[0].astype(float)]
            return pa.record_batch([pa.array(x) for x in columns], names=["query_row", "query_id", "vec_id", "vec_row", "score"])

        for batch in batches:
            own, kind, dims = (batch.column(i).to_numpy() for i in range(3))
            cuts = np.append(0, np.flatnonzero((own[1:] != own[:-1]) | (kind[1:] != kind[:-1]) | (dims[1:] != dims[:-1])) + 1)
            for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(own)], strict=True):
                if a == b:
                    continue
                dim = int(dims[a])
                if cell is None or (dim, own[a]) != now:
                    if cell is not None:
                        yield result(cell)
                    cell, now = Cell(k, dim, epsilon), (dim, own[a])
                part = batch.slice(a, b - a)
                rows_, ids, x = part.column(3).to_numpy(), part.column(4).to_numpy(), scaled(_matrix(part.column(5), dim))
                if kind[a]:
                    words = np.frombuffer(b"".join(part.column(6).to_pylist()), np.uint64).reshape(len(part), -1)
                    cell.add_rows(ids, rows_, x, words, part.column(7).to_numpy())
                else:
                    cell.add_queries(ids, rows_, x)
        if cell is not None:
            yield result(cell)

    dealt = cells.repartitionById(int(cells_of_all), F.pmod(F.col("cell") + F.col("dim") * 7, F.lit(int(cells_of_all))).cast("int"))
    found = dealt.sortWithinPartitions("dim", "cell", "kind").mapInArrow(run, schema)
    rank = F.row_number().over(W.partitionBy("query_row").orderBy(F.col("score").desc(), "vec_id", "vec_row"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
