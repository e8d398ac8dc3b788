"""Removing repeated passages: fixed-block anchors, extended to maximal repeats by exact windows.

A window of `width` words contains a whole block of (width + 1) // 2 words that starts at a multiple of that
length in its own document. So: (1) these non-overlapping blocks of all documents are the index; every rolling
window of that length of every document probes it. A hash with an index block and two or more documents makes
each of its places a hit. (2) From each hit the repeat is extended to both sides: the windows of `width` words that
hold the hit are compared exactly, by a 64-bit hash of all their words; one that a smaller doc_id has too is a repeat. A
block is hit again wherever the repeat goes on, so extension goes on with it. (3) Repeats that overlap or follow
each other join to the maximal repeats; their words go.

Rows: doc_ids compare, but do not name a row. The table is numbered and written once, and places belong to row
numbers, so rows that share a doc_id, or have none, are apart, and no key of a join is hot.

No pairs are made: both comparisons are groupings by hash that keep a smallest document, so a passage in n
documents costs n records. Records are pre-aggregated in each task: what a task can settle among its own
documents does not travel, but for two representatives a hash, so a passage that is everywhere sends two records
per task. Buckets are hash ranges whose number grows with the input, as does the number of partitions of the
joins. Texts are shuffled once, by row; both joins read the same exchange.

Cases: a null or empty text has no words; a null doc_id counts as smaller than every other; rows with the same
doc_id never remove from each other; very long texts are processed whole; an empty table gives an empty table;
extra columns of any name pass through.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, written
from .pieces import mixed
from .wordarrays import (
    batch_words,
    bucket_of,
    gathered,
    id_array,
    inner_windows,
    pack,
    unpack,
    window_hashes,
)

RECORDS = "bucket int, kind int, data binary"
PLACES = "key long, places binary"
PROBE, SETTLED = 0, 1
#: Bytes of text for each bucket of records, about 700,000 words, and for each partition of the joins.
BUCKET_BYTES, JOIN_BYTES = 4_000_000, 32_000_000


def _records(buckets: int, hash_bytes: int, hashes, rows, docs, pos, settled) -> Iterator[pa.RecordBatch]:
    """Rows of RECORDS: open records by bucket; settled places in buckets by row."""
    out = {"bucket": [], "kind": [], "data": []}
    for kind, mask in ((PROBE, ~settled[0]), (SETTLED, settled[1])):
        own = np.flatnonzero(mask)
        if not len(own):
            continue
        of = bucket_of(hashes[own], buckets) if kind == PROBE else np.zeros(len(own), np.int64) + int(rows[own[0]]) % buckets
        order = np.argsort(of.astype(np.int32), kind="stable")
        own, of = own[order], of[order]
        cuts = np.append(0, np.flatnonzero(of[1:] != of[:-1]) + 1)
        for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(of)], strict=True):
            part = own[a:b]
            out["bucket"].append(int(of[a]))
            out["kind"].append(kind)
            out["data"].append(pack(hashes[part], rows[part], docs[part], pos[part], hash_bytes if kind == PROBE else 0))
    kinds = {"bucket": pa.int32(), "kind": pa.int32(), "data": pa.binary()}
    for at in range(0, len(out["bucket"]), 64):
        yield pa.record_batch([pa.array(out[k][at : at + 64], t) for k, t in kinds.items()], names=list(kinds))


def _groups(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order by hash, and where groups of equal hashes begin in it."""
    order = np.argsort(hashes, kind="stable")
    sorted_ = hashes[order]
    return order, np.append(0, np.flatnonzero(sorted_[1:] != sorted_[:-1]) + 1) if len(order) else np.zeros(0, np.int64)


def _spread(values: np.ndarray, begins: np.ndarray, n: int) -> np.ndarray:
    return np.repeat(values, np.diff(np.append(begins, n)))


def anchor_hits(hashes, docs, pos, block: int) -> tuple[np.ndarray, np.ndarray]:
    """(settled, hit) of each record: in a group with an index block and two documents all places are hits, and all
    are settled but two that stay open for other tasks: an index place, and a place of another document, so that
    a task with only one of these documents still learns of the other."""
    n = len(hashes)
    settled, hit = np.zeros(n, bool), np.zeros(n, bool)
    if not n:
        return settled, hit
    order, begins = _groups(hashes)
    docs_, index = docs[order], pos[order] % block == 0
    good = np.logical_or.reduceat(index, begins) & (np.minimum.reduceat(docs_, begins) != np.maximum.reduceat(docs_, begins))
    if good.any():
        inside = _spread(good, begins, n)
        at = np.arange(n)
        first = np.minimum.reduceat(np.where(index, at, n), begins)
        owner = _spread(docs_[np.minimum(first, n - 1)], begins, n)
        second = np.minimum.reduceat(np.where(docs_ != owner, at, n), begins)
        hit[order[inside]] = True
        settled[order[inside]] = True
        settled[order[first[good]]] = False
        settled[order[second[good]]] = False
    return settled, hit


def window_repeats(hashes, docs, _pos, _block: int) -> tuple[np.ndarray, np.ndarray]:
    """(settled, repeat): a record is a repeat if its group has a smaller document, and is settled then; those of the
    smallest document stay open."""
    n = len(hashes)
    settled, repeat = np.zeros(n, bool), np.zeros(n, bool)
    if not n:
        return settled, repeat
    order, begins = _groups(hashes)
    docs_ = docs[order]
    least = _spread(np.minimum.reduceat(docs_, begins), begins, n)
    repeat[order] = docs_ > least
    return repeat.copy(), repeat


def _exchange(records: DataFrame, buckets: int, hash_bytes: int, decide, block: int) -> DataFrame:
    """PLACES, one line for each row of the table: the places that decide() marks among all records of a bucket, and the
    settled ones. Places leave a bucket packed by ranges of rows, so that the number of lines follows the
    rows and not rows times buckets."""
    ranges = max(1, buckets // 4)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, done = [], []
        for batch in batches:
            for bucket, kind, data in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                hashes, rows, docs, pos = unpack(data, hash_bytes if kind == PROBE else 0)
                if kind == PROBE:
                    if hash_bytes < 8:
                        hashes = hashes | np.uint64(bucket) << np.uint64(8 * hash_bytes)
                    parts.append((hashes, rows, docs, pos))
                else:
                    done.append((rows, pos))
        if parts:
            hashes, rows, docs, pos = (np.concatenate(x) for x in zip(*parts, strict=True))
            del parts
            _, marked = decide(hashes, docs, pos, block)
            done.append((rows[marked], pos[marked]))
        if not done:
            return
        rows, pos = (np.concatenate(x) for x in zip(*done, strict=True))
        of = (mixed(rows.view(np.uint64)) % np.uint64(ranges)).astype(np.int64)
        order = np.lexsort((pos, rows, of))
        rows, pos, of = rows[order], pos[order], of[order]
        cuts = np.append(0, np.flatnonzero(of[1:] != of[:-1]) + 1)
        for at in range(0, len(cuts) if len(of) else 0, 64):
            ends = np.append(cuts[1:], len(of))[at : at + 64].tolist()
            own = [(int(of[a]), pack(rows[a:b].view(np.uint64), rows[a:b], rows[a:b], pos[a:b], 0)) for a, b in zip(cuts[at : at + 64].tolist(), ends, strict=True)]
            yield pa.record_batch([pa.array([x for x, _ in own], pa.int32()), pa.array([x for _, x in own], pa.binary())], names=["range", "data"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [unpack(x, 0) for batch in batches for x in batch.column(1).to_pylist()]
        if parts:
            yield from _places(np.concatenate([p[1] for p in parts]), np.concatenate([p[3] for p in parts]))

    marked = records.repartition(buckets, "bucket").mapInArrow(run, "range int, data binary")
    return marked.repartition(ranges, "range").mapInArrow(merge, PLACES)


def _places(rows: np.ndarray, pos: np.ndarray) -> Iterator[pa.RecordBatch]:
    """One line for each row: its positions, each once, as 4-byte integers."""
    if not len(rows):
        return
    order = np.lexsort((pos, rows))
    rows, pos = rows[order], pos[order]
    new = np.append(True, (rows[1:] != rows[:-1]) | (pos[1:] != pos[:-1]))
    rows, data = rows[new], pos[new].astype("<u4").tobytes()
    cuts = np.append(0, np.flatnonzero(rows[1:] != rows[:-1]) + 1)
    ends = np.append(cuts[1:], len(rows))
    for at in range(0, len(cuts), 5000):
        a, b = cuts[at : at + 5000], ends[at : at + 5000]
        places = [data[4 * x : 4 * y] for x, y in zip(a.tolist(), b.tolist(), strict=True)]
        yield pa.record_batch([pa.array(rows[a]), pa.array(places, pa.binary())], names=["key", "places"])


def _positions(places: bytes | None) -> np.ndarray:
    return np.frombuffer(places or b"", "<u4").astype(np.int64)


def _with_places(table: DataFrame, width: int, keep: list[str]) -> DataFrame:
    """The columns `keep` of table, with the starts of the repeated windows of each row as a last binary column."""
    block = (width + 1) // 2
    name = {x: fresh(*table.columns, base=x) for x in ("_row", "_key", "_places")}
    row = name["_row"]
    table = written(table.withColumn(row, F.monotonically_increasing_id()))
    size = table.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shuffles = int(table.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets, parts = max(shuffles, -(-size // BUCKET_BYTES)), max(shuffles, -(-size // JOIN_BYTES))
    slim = table.select(row, F.col("doc_id").cast("long").alias("doc_id"), "text")

    def probes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in gathered(batches, 2):
            words, counts = batch_words(batch, 2)
            at, text, pos = inner_windows(counts, block, least=width)
            hashes = window_hashes(words, block)[at]
            rows, docs = batch.column(0).to_numpy()[text], id_array(batch.column(1))[text]
            del words, at, text
            settled, hit = anchor_hits(hashes, docs, pos, block)
            yield from _records(buckets, 5, hashes, rows, docs, pos, (settled, hit))

    hits = written(_exchange(slim.mapInArrow(probes, RECORDS), buckets, 5, anchor_hits, block))

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in gathered(batches, 2):
            words, counts = batch_words(batch, 2)
            begin = np.cumsum(counts) - counts
            text, pos = [], []
            for i, parts in enumerate(batch.column(3).to_pylist()):
                if parts and counts[i] >= width:
                    at = _positions(parts)
                    near = (at[:, None] + np.arange(block - width, 1)).ravel()
                    near = np.unique(near[(near >= 0) & (near <= counts[i] - width)])
                    text.append(np.full(len(near), i))
                    pos.append(near)
            if not text:
                continue
            text, pos = np.concatenate(text), np.concatenate(pos)
            hashes = window_hashes(words, width, salt=0x5851F42D4C957F2D)[begin[text] + pos]
            rows, docs = batch.column(0).to_numpy()[text], id_array(batch.column(1))[text]
            settled, repeat = window_repeats(hashes, docs, pos, block)
            yield from _records(buckets, 8, hashes, rows, docs, pos, (settled, repeat))

    def joined(left: DataFrame, places: DataFrame, columns: list[str]) -> DataFrame:
        there = places.repartition(parts, "key").select(F.col("key").alias(name["_key"]), F.col("places").alias(name["_places"]))
        return left.repartition(parts, row).join(there, F.col(row) == F.col(name["_key"]), "left").select(*columns, name["_places"])

    near = joined(slim, hits, [row, "doc_id", "text"])
    repeats = _exchange(near.mapInArrow(windows, RECORDS), buckets, 8, window_repeats, block)
    return joined(slim if keep == ["doc_id", "text"] else table, repeats, keep)


def covered(places: np.ndarray, n: int, width: int) -> np.ndarray:
    """True for words that a repeated window covers."""
    step = np.zeros(n + 1, np.int32)
    np.add.at(step, places, 1)
    np.add.at(step, places + width, -1)
    return np.cumsum(step[:n]) > 0


def _kept_words(text: str | None, places: np.ndarray, width: int) -> tuple[list[bytes], int]:
    words = (text or "").encode().split()
    if not len(places):
        return words, 0
    gone = covered(places[places <= len(words) - width], len(words), width)
    return [w for w, g in zip(words, gone.tolist(), strict=True) if not g], int(gone.sum())


def digest_kept(docs: DataFrame, width: int = 13) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every document."""
    rows = _with_places(docs.select("doc_id", "text"), width, ["doc_id", "text"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, parts in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                words, gone = _kept_words(text, _positions(parts), width)
                out.append((len(words) + gone, gone, hashlib.sha256(b" ".join(words)).hexdigest()))
            n, gone, sha = zip(*out, strict=True) if out else ((), (), ())
            yield pa.record_batch([batch.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    return rows.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def remove_repeats(docs: DataFrame, width: int = 13) -> DataFrame:
    """docs with the words of repeated passages taken out of text; a text that loses nothing stays as it is,
    another becomes its kept words joined by single spaces. Other columns pass through."""
    rows = _with_places(docs, width, docs.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("text")
            texts = []
            for text, parts in zip(batch.column(at).to_pylist(), batch.column(batch.num_columns - 1).to_pylist(), strict=True):
                words, gone = _kept_words(text, _positions(parts), width)
                texts.append(b" ".join(words).decode() if gone else text)
            columns = batch.columns[:-1]
            columns[at] = pa.array(texts, pa.string())
            yield pa.record_batch(columns, schema=pa.schema([batch.schema.field(i) for i in range(batch.num_columns - 1)]))

    return rows.mapInArrow(run, docs.schema)
