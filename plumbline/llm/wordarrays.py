"""Words of whole Arrow batches as numpy arrays, and the exchange of (hash, document, position) records.

Words are maximal runs of bytes other than the six ASCII white-space bytes; UTF-8 never has those inside a
character, so byte runs are the words of the text. All hashes are 64-bit polynomial hashes over random values.

A record exchange sends records to buckets by the top bits of their hash. The records of one task and bucket
travel as one byte string: the rest of the hash in `hash_bytes` bytes, then documents and positions as
differences in byte planes, whose zero planes the shuffle's compression removes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .pieces import STEP, STEP_INVERSE, mixed, power

#: Bytes of text in work at a time, and bytes of text whose records are gathered before they are sent.
BLOCK_BYTES, FLUSH_BYTES = 2_000_000, 12_000_000
#: Stands for a null doc_id: smaller than every other.
NULL_ID = -(2**63)

_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_BYTE_VALUES = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and the offsets of each; a null text is empty."""
    column = pc.fill_null(column, "")
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    whole = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and the number of words of each text."""
    n = len(data)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    inside = ~_BLANK[data]
    start, end = inside.copy(), inside.copy()
    start[1:] &= ~inside[:-1] | edge[1:n]
    end[:-1] &= ~inside[1:] | edge[1:n]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    return starts, ends, np.diff(np.searchsorted(starts, offsets))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE_VALUES[data] * power(STEP, len(data)), out=sums[1:])
    span = (sums[ends] - sums[starts]) * power(STEP_INVERSE, len(data) + 1)[starts]
    return mixed(span ^ (ends - starts).astype(np.uint64))


def window_hashes(words: np.ndarray, width: int, salt: int = 0) -> np.ndarray:
    """Hashes of all windows of `width` words, those that cross texts included."""
    if len(words) < width:
        return np.zeros(0, np.uint64)
    values = mixed(words ^ np.uint64(salt)) if salt else words
    sums = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(values * power(STEP, len(words)), out=sums[1:])
    return mixed((sums[width:] - sums[:-width]) * power(STEP_INVERSE, len(words) - width + 1))


def inner_windows(counts: np.ndarray, width: int, least: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the windows of `width` words within one text of `least` words or more: index of the first word
    overall, text, position in it."""
    n = np.where(counts >= least, np.maximum(counts - (width - 1), 0), 0)
    text = np.repeat(np.arange(len(counts)), n)
    pos = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    return (np.cumsum(counts) - counts)[text] + pos, text, pos


def id_array(column: pa.Array) -> np.ndarray:
    return pc.fill_null(column, NULL_ID).to_numpy(zero_copy_only=False).astype(np.int64)



def batch_words(batch: pa.RecordBatch, text_at: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of a batch, and the number of words of each text; in blocks of bounded size."""
    data, offsets = text_bytes(batch.column(text_at))
    hashes, counts, row = [], [], 0
    while row < len(batch):
        to = max(row + 1, int(np.searchsorted(offsets, offsets[row] + BLOCK_BYTES, "right")) - 1)
        own, off = data[offsets[row] : offsets[to]], offsets[row : to + 1] - offsets[row]
        starts, ends, n = word_spans(own, off)
        hashes.append(word_hashes(own, starts, ends))
        counts.append(n)
        row = to
    join = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
    return join(hashes, np.uint64), join(counts, np.int64)


def gathered(batches: Iterator[pa.RecordBatch], text_at: int, limit: int = FLUSH_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows in batches of about `limit` bytes of text; a longer text is a batch of its own."""
    waiting, size = [], 0
    for batch in batches:
        _, offsets = text_bytes(batch.column(text_at))
        row = 0
        while row < len(batch):
            to = max(row + 1, int(np.searchsorted(offsets, offsets[row] + max(0, limit - size), "right")) - 1)
            if waiting and offsets[row + 1] - offsets[row] > limit - size:
                yield _joined(waiting)
                waiting, size = [], 0
                continue
            waiting.append(batch.slice(row, to - row))
            size += int(offsets[to] - offsets[row])
            row = to
            if size >= limit:
                yield _joined(waiting)
                waiting, size = [], 0
    if waiting:
        yield _joined(waiting)


def _joined(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    return pa.Table.from_batches(batches).combine_chunks().to_batches()[0] if len(batches) > 1 else batches[0]


def _planes(x: np.ndarray, n: int) -> bytes:
    return np.ascontiguousarray(x.astype(f"<u{n}").view(np.uint8).reshape(-1, n).T).tobytes()


def _unplanes(data: bytes, at: int, count: int, n: int) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8, count * n, at).reshape(n, count)
    return np.ascontiguousarray(planes.T).view(f"<u{n}").reshape(-1)


def pack(hashes: np.ndarray, rows: np.ndarray, docs: np.ndarray, pos: np.ndarray, hash_bytes: int) -> bytes:
    """Records in the order of rows and positions as a byte string. All records of a row have its document."""
    lead = np.flatnonzero(np.append(True, rows[1:] != rows[:-1])) if len(rows) else np.zeros(0, np.int64)
    counts = np.diff(np.append(lead, len(rows)))
    step = np.diff(pos, prepend=0)
    step[lead] = pos[lead]
    names = [np.diff(x[lead], prepend=0).astype(np.int64).view(np.uint64) for x in (rows, docs)]
    raw = np.ascontiguousarray(hashes.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :hash_bytes]).tobytes()
    head = np.array([len(rows), len(lead)], "<u4").tobytes()
    return b"".join([head, *[_planes(x, 8) for x in names], _planes(counts, 4), _planes(step, 4), raw])


def unpack(data: bytes, hash_bytes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """hashes, rows, documents, positions."""
    n, k = np.frombuffer(data, "<u4", 2).tolist()
    at = 8
    rows, docs = (np.cumsum(_unplanes(data, at + 8 * k * i, k, 8).view(np.int64)) for i in range(2))
    at += 16 * k
    counts = _unplanes(data, at, k, 4).astype(np.int64)
    step = _unplanes(data, at + 4 * k, n, 4).astype(np.int64)
    lead = np.cumsum(counts) - counts
    run = np.cumsum(step)
    pos = run - np.repeat(run[lead] - step[lead], counts)
    hashes = np.zeros((n, 8), np.uint8)
    hashes[:, :hash_bytes] = np.frombuffer(data, np.uint8, n * hash_bytes, at + 4 * k + 4 * n).reshape(n, hash_bytes)
    return hashes.view("<u8").reshape(-1), np.repeat(rows, counts), np.repeat(docs, counts), pos


def bucket_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return ((hashes >> np.uint64(44)) * np.uint64(buckets) >> np.uint64(20)).astype(np.int64)
