"""Periodic runs of words by Crochemore's partition refinement.

A run is a stretch of words with smallest period q and a length of at least max(least, exponent * q) that no neighbour
extends. Positions of a text are in one class of level l if the l words from them on are equal. Level l + 1 refines
level l: two positions stay together if those right after them do. It is enough to tell apart the predecessors
of what split off at level l, the largest part of each split class excepted (the smaller-half strategy), so a text of n
words takes n log n steps, and each position knows its neighbours in its class. A position whose next neighbour at level l
is exactly l words on begins a square of primitive period l; consecutive such positions merge into a run. A run of
`exponent` periods keeps exponent - 1 members in each of its classes, so smaller classes are dropped at once, which
is where ordinary prose ends after a few levels.

Texts are whole and independent: the operator is a narrow step without a shuffle. In a task, texts of about BLOCK bytes
are refined together, level by level, in numpy; a longer text is a block of its own. Words get exact numbers by
dictionary encoding, so no hash decides.

Cases: a null or empty text, or one without words, has no runs; a null doc_id passes through; repeated rows are separate;
runs of different periods may overlap, and a word is dropped if any of them says so; very long texts are read whole; an empty
table gives an empty table; extra columns of any name pass through collapsed().
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .wordarrays import gathered, text_bytes, word_spans

#: Bytes of text that are refined together.
BLOCK = 16_000_000
LEAST, EXPONENT = 6, 4
RUN_SCHEMA = "doc_id long, start long, length long, period long"

#: Gives the word order of a text from its doc_id and number of words; None leaves it.
Prepare = Callable[[int | None, int], np.ndarray | None]


def planted_period(doc_id: int | None, n: int) -> np.ndarray | None:
    """For a tenth of the ids: words from some place on repeat with a period; the rule is that of the query's contract."""
    h = None if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h is None or h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    order = np.arange(n)
    order[a:] = a + (order[a:] - a) % p
    return order


def _segments(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers of all segments [start, start + size), one after the other."""
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))


def _heads(*columns: np.ndarray) -> np.ndarray:
    """Where rows that are sorted by columns begin to differ from the row before."""
    new = np.ones(len(columns[0]), bool)
    if len(new):
        new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return np.flatnonzero(new)


class Partition:
    """Classes of the positions of some texts, each text followed by an end mark, and their neighbours.

    members holds the positions class by class (start, size), in no order within a class; at is its inverse; next and prev link
    the positions of a class in ascending order. Dropped positions have class -1."""

    def __init__(self, words: np.ndarray, counts: np.ndarray, exponent: int):
        self.few = max(2, exponent - 1)
        n = len(words) + len(counts)
        ends = np.cumsum(counts + 1) - 1
        text = np.repeat(np.arange(len(counts)), counts + 1)
        self.limit = np.repeat(counts // exponent, counts + 1)  # periods above are not asked for
        name = np.empty(n, np.int64)
        inner = np.ones(n, bool)
        inner[ends] = False
        top = int(words.max()) + 1 if len(words) else 0
        name[inner] = words
        name[ends] = top
        order = np.argsort(text * (top + 1) + name, kind="stable")
        heads = _heads(text[order], name[order])
        sizes = np.diff(np.append(heads, n))
        label = np.repeat(np.arange(len(heads)), sizes)
        big = sizes >= self.few
        number = np.where(big, np.cumsum(big) - 1, -1)
        self.of = np.empty(n, np.int64)
        self.of[order] = number[label]
        self.members, self.at = order.copy(), np.empty(n, np.int64)
        self.at[order] = np.arange(n)
        self.start, self.size, self.classes = heads[big], sizes[big], int(big.sum())
        self.next, self.prev = np.full(n, -1), np.full(n, -1)
        inside = np.ones(n, bool)
        inside[heads] = False
        later = np.flatnonzero(inside)
        self.next[order[later - 1]], self.prev[order[later]] = order[later], order[later - 1]
        self.marked = np.zeros(n, bool)
        self.level, self.due = 1, {}
        self.split, self.labels = order, label  # what split off at this level, and the part each belongs to
        self._await(order)

    def _await(self, places: np.ndarray) -> None:
        """Notes at which level the gap from each of places to its neighbour makes a square."""
        places = places[(self.of[places] >= 0) & (self.next[places] >= 0)]
        gap = self.next[places] - places
        ok = (gap >= self.level) & (gap <= self.limit[places])
        places, gap = places[ok], gap[ok]
        if not len(places):
            return
        order = np.argsort(gap, kind="stable")
        places, gap = places[order], gap[order]
        heads = _heads(gap)
        for a, b in zip(heads.tolist(), [*heads[1:].tolist(), len(gap)], strict=True):
            self.due.setdefault(int(gap[a]), []).append(places[a:b])

    def squares(self) -> np.ndarray:
        """Positions in ascending order whose next neighbour is as far as the level is long."""
        found = self.due.pop(self.level, None)
        if found is None:
            return np.zeros(0, np.int64)
        found = np.unique(np.concatenate(found))
        return found[(self.of[found] >= 0) & (self.next[found] - found == self.level)]

    def refine(self) -> bool:
        """Goes to the next level that can have squares; false if there is none."""
        if not len(self.split):
            self.level = min(self.due, default=0)
            return bool(self.due)
        self.level += 1
        pos = self.split - 1
        ok = pos >= 0
        pos, label = pos[ok], self.labels[ok]
        ok = (self.of[pos] >= 0) & (self.limit[pos] >= self.level)
        pos, label = pos[ok], label[ok]
        self.split = self.labels = np.zeros(0, np.int64)
        if not len(pos):
            return True
        order = np.lexsort((pos, label, self.of[pos]))
        pos, label = pos[order], label[order]
        own = self.of[pos]
        heads, parts = _heads(own), _heads(own, label)
        count = np.diff(np.append(heads, len(own)))
        whole = self.size[own[heads]]
        n_parts = np.diff(np.append(np.searchsorted(parts, heads), len(parts)))
        real = (count < whole) | (n_parts > 1)
        if not real.all():
            stay = np.repeat(real, count)
            pos, label, own = pos[stay], label[stay], own[stay]
            if not len(pos):
                return True
            count, whole = count[real], whole[real]
            heads, parts = _heads(own), _heads(own, label)
        self._part(pos, own, heads, parts, count, whole)
        return True

    def _part(self, pos, own, heads, parts, count, whole) -> None:
        """Takes pos (sorted by class, part, place) out of their classes; each part becomes a class of its own."""
        classes = own[heads]
        # what stays in a class closes its links over what leaves
        by = np.lexsort((pos, own))
        x = pos[by]
        first = np.ones(len(x), bool)
        first[1:] = self.next[x[:-1]] != x[1:]
        begins = np.flatnonzero(first)
        left, right = self.prev[x[begins]], self.next[x[np.append(begins[1:], len(x)) - 1]]
        has_left, has_right = left >= 0, right >= 0
        self.next[left[has_left]] = right[has_left]
        self.prev[right[has_right]] = left[has_right]
        closed = left[has_left & has_right]
        # the parts get links of their own
        sizes = np.diff(np.append(parts, len(pos)))
        after, before = np.append(pos[1:], -1), np.append(-1, pos[:-1])
        after[np.append(parts[1:], len(pos)) - 1] = -1
        before[parts] = -1
        moved = pos[self.next[pos] != after]
        self.next[pos], self.prev[pos] = after, before
        # what leaves goes to the front of its class's segment
        slots = _segments(self.start[classes], count)
        self.marked[pos] = True
        there = self.members[slots]
        there = there[~self.marked[there]]
        free = self.at[pos]
        free = free[free >= np.repeat(self.start[classes] + count, count)]
        self.members[free], self.at[there] = there, free
        self.members[slots], self.at[pos] = pos, slots
        self.marked[pos] = False
        rest = whole - count
        self.start[classes] += count
        self.size[classes] = rest
        # numbers for parts that are large enough
        big = sizes >= self.few
        number = np.where(big, self.classes + np.cumsum(big) - 1, -1)
        self.of[pos] = np.repeat(number, sizes)
        new = int(big.sum())
        if self.classes + new > len(self.start):
            room = max(1024, len(self.start), new)
            self.start, self.size = np.append(self.start, np.zeros(room, np.int64)), np.append(self.size, np.zeros(room, np.int64))
        self.start[self.classes : self.classes + new] = slots[parts[big]]
        self.size[self.classes : self.classes + new] = sizes[big]
        self.classes += new
        # all but the largest part of each class split off; what stays counts as a part
        class_of = np.searchsorted(heads, parts, "right") - 1
        largest = np.maximum.reduceat(sizes, np.searchsorted(parts, heads))
        stays = rest >= largest
        largest_part = (sizes == largest[class_of]) & ~stays[class_of]
        at = np.flatnonzero(largest_part)
        at = at[_heads(class_of[at])] if len(at) else at  # one of equally large parts
        small = np.ones(len(sizes), bool)
        small[at] = False
        also = np.flatnonzero((rest > 0) & ~stays)
        kept = _segments(self.start[classes[also]], rest[also])
        keep = np.repeat(small, sizes)
        self.split = np.append(pos[keep], self.members[kept])
        self.labels = np.append(np.repeat(np.arange(len(sizes)), sizes)[keep], np.repeat(len(sizes) + np.arange(len(also)), rest[also]))
        gone = np.flatnonzero((rest > 0) & (rest < self.few))
        self.of[self.members[_segments(self.start[classes[gone]], rest[gone])]] = -1
        self._await(np.append(closed, moved))


def runs_of(words: np.ndarray, counts: np.ndarray, least: int = LEAST, exponent: int = EXPONENT) -> tuple[np.ndarray, ...]:
    """words: numbers of the words of some texts one after the other; counts: words of each text. Text, start, length and
    period of all runs, by text, start, period."""
    found = [np.zeros((0, 4), np.int64)]
    if len(words):
        begin = np.cumsum(counts + 1) - (counts + 1)
        classes = Partition(words, counts, exponent)
        while True:
            at, q = classes.squares(), classes.level
            if len(at):
                # squares of one period are within one text, so consecutive places are too
                first = np.flatnonzero(np.append(True, at[1:] != at[:-1] + 1))
                length = np.diff(np.append(first, len(at))) + 2 * q - 1
                ok = length >= max(least, exponent * q)
                text = np.searchsorted(begin, at[first[ok]], "right") - 1
                found.append(np.column_stack([text, at[first[ok]] - begin[text], length[ok], np.full(len(text), q)]))
            if not classes.refine():
                break
    out = np.concatenate(found)
    return tuple(out[np.lexsort((out[:, 3], out[:, 1], out[:, 0]))].T)


def _numbered(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Exact numbers of all words, and the words of each text."""
    starts, ends, counts = word_spans(data, offsets)
    cut = np.append(0, np.cumsum(ends - starts)).astype(np.int32)
    own = data[_segments(starts, ends - starts)]
    words = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(cut.tobytes()), pa.py_buffer(own.tobytes())])
    return words.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64), counts


def _blocks(batches: Iterator[pa.RecordBatch], id_at: int, text_at: int, prepare: Prepare | None, least: int, exponent: int):
    """For each block of rows: the batch, and for each row the runs (start, length, period) and the order of its words."""
    for batch in gathered(batches, text_at, BLOCK):
        data, offsets = text_bytes(batch.column(text_at))
        words, counts = _numbered(data, offsets)
        begin = np.cumsum(counts) - counts
        orders = {}
        if prepare is not None:
            for i, doc_id in enumerate(batch.column(id_at).to_pylist()):
                order = prepare(doc_id, int(counts[i]))
                if order is not None:
                    orders[i] = order
                    words[begin[i] : begin[i] + counts[i]] = words[begin[i] : begin[i] + counts[i]][order]
        text, *run = runs_of(words, counts, least, exponent)
        run = np.column_stack(run)
        cuts = np.searchsorted(text, np.arange(len(counts) + 1))
        yield batch, [run[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)], orders


def _kept(text: str | None, run: np.ndarray, order: np.ndarray | None) -> list[bytes]:
    """The words that stay: of each run its first period, and all that no run holds."""
    words = (text or "").encode().split()
    if order is not None:
        words = [words[i] for i in order.tolist()]
    if not len(run):
        return words
    step = np.zeros(len(words) + 1, np.int64)
    np.add.at(step, run[:, 0] + run[:, 2], 1)
    np.add.at(step, run[:, 0] + run[:, 1], -1)
    return [w for w, gone in zip(words, (np.cumsum(step[:-1]) > 0).tolist(), strict=True) if not gone]


def _greatest(run: np.ndarray) -> tuple[int, int, int]:
    """The run of the greatest length / period, compared exactly; ties: smallest start, then period."""
    best = None
    for start, length, period in run.tolist():  # in order of start, then period
        if best is None or length * best[2] > best[1] * period:
            best = (start, length, period)
    return best


def runs(docs: DataFrame, prepare: Prepare | None = None, least: int = LEAST, exponent: int = EXPONENT) -> DataFrame:
    """One row for each run: doc_id, start (word number), length and period in words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, found, _ in _blocks(batches, 0, 1, prepare, least, exponent):
            ids = _repeated(batch.column(0), [len(r) for r in found])
            flat = np.concatenate(found) if found else np.zeros((0, 3), np.int64)
            yield pa.record_batch([ids, *(pa.array(flat[:, i]) for i in range(3))], names=["doc_id", "start", "length", "period"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, RUN_SCHEMA)


def _repeated(column: pa.Array, times: list[int]) -> pa.Array:
    return column.take(pa.array(np.repeat(np.arange(len(column)), times)))


def digest_runs(docs: DataFrame, prepare: Prepare | None = None) -> DataFrame:
    """doc_id, n_runs, start, length, period and exponent_milli of the run with the most periods, digests of all runs and of
    the words that stay."""
    longs, digests = ["n_runs", "start", "length", "period", "exponent_milli"], ["runs_sha256", "collapsed_sha256"]
    schema = ", ".join(["doc_id long", *(f"{c} long" for c in longs), *(f"{c} string" for c in digests)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, found, orders in _blocks(batches, 0, 1, prepare, LEAST, EXPONENT):
            out = []
            for i, (text, own) in enumerate(zip(batch.column(1).to_pylist(), found, strict=True)):
                best = (*b, 1000 * b[1] // b[2]) if (b := _greatest(own)) else (None,) * 4
                lines = "".join(f"{s},{n},{p}\n" for s, n, p in own.tolist())
                kept = b" ".join(_kept(text, own, orders.get(i)))
                out.append((len(own), *best, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest()))
            columns = list(zip(*out, strict=True)) if out else [()] * 7
            kinds = [pa.int64()] * 5 + [pa.string()] * 2
            yield pa.record_batch([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=["doc_id", *longs, *digests])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def collapsed(docs: DataFrame, least: int = LEAST, exponent: int = EXPONENT) -> DataFrame:
    """docs with each run in text reduced to its first period; a text without runs stays as it is, another becomes its kept
    words joined by single spaces."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, found, _ in _blocks(batches, 0, at, None, least, exponent):
            texts = [b" ".join(_kept(t, r, None)).decode() if len(r) else t for t, r in zip(batch.column(at).to_pylist(), found, strict=True)]
            columns = batch.columns
            columns[at] = pa.array(texts, batch.schema.field(at).type)
            yield pa.record_batch(columns, schema=batch.schema)

    return docs.mapInArrow(run, docs.schema)
