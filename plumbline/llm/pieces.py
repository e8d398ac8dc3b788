"""Splitting texts into the pieces of the public byte-level BPE pattern, for whole batches in numpy.

The pattern is: 's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+

Every code point has a class (white space, letter, number, other). A piece starts where the class changes,
with three exceptions: one U+0020 before a run belongs to the run; of several white-space characters before
a run, all but the last form a piece; an apostrophe that starts a piece and is alone in its run takes the
ending of a contraction with it.

PieceCache turns pieces into ids: each distinct piece of a block of texts is encoded once, and pieces seen
before are looked up by a 64-bit hash in sorted arrays of bounded size.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np

SPACE, LETTER, NUMBER, OTHER = 0, 1, 2, 3
#: The characters with the Unicode property White_Space (fixed values).
WHITE_SPACE = (
    *range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000,
)
#: Code points of a block that are in work at a time; arrays of 8 bytes a code point stay within 20 MB.
BLOCK_CHARS = 2_000_000
#: Code points whose new pieces are encoded together.
FLUSH_CHARS = 24_000_000


@cache
def class_table() -> np.ndarray:
    """The class of each code point."""
    kinds = {"L": LETTER, "N": NUMBER}
    table = np.array([kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)], np.uint8)
    table[list(WHITE_SPACE)] = SPACE
    return table


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, element by element."""
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: An odd multiplier and its inverse modulo 2**64.
STEP = 0x9E3779B97F4A7C15
STEP_INVERSE = pow(STEP, -1, 2**64)


@cache
def char_values() -> np.ndarray:
    return mixed(np.arange(1, 0x110001, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))


def powers(base: int, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        out = np.full(n, base, np.uint64)
        out[:1] = 1
        return np.cumprod(out, dtype=np.uint64)


_POWERS: dict[int, np.ndarray] = {}


def power(base: int, n: int) -> np.ndarray:
    if base not in _POWERS or len(_POWERS[base]) < n:
        _POWERS[base] = powers(base, max(n, BLOCK_CHARS + 1))
    return _POWERS[base][:n]


def span_hashes(points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span [start, end) of points."""
    sums = np.zeros(len(points) + 1, np.uint64)
    np.cumsum(char_values()[points] * power(STEP, len(points)), out=sums[1:])
    span = (sums[ends] - sums[starts]) * power(STEP_INVERSE, len(points) + 1)[starts]
    return mixed(span ^ (ends - starts).astype(np.uint64))


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def piece_starts(points: np.ndarray, first: np.ndarray) -> np.ndarray:
    """True where a piece starts. first: true where a text starts."""
    n = len(points)
    kind = class_table()[points]
    start = np.ones(n, bool)
    if n > 1:
        start[1:] = first[1:] | (kind[1:] != kind[:-1])
        run = start.copy()
        nxt_word = np.zeros(n, bool)  # a white-space character right before a word of the same text
        nxt_word[:-1] = (kind[:-1] == SPACE) & (kind[1:] != SPACE) & ~first[1:]
        attached = np.zeros(n, bool)  # words that take the space before them
        attached[1:] = nxt_word[:-1] & (points[:-1] == 0x20)
        start = (run & ~attached) | nxt_word
        lone = (points == 0x27) & run & start
        at = np.flatnonzero(lone)
        at = at[at + 1 < n]
        at = at[run[at + 1] & ~first[at + 1] & (kind[at + 1] == LETTER)]
        if len(at):
            one, two = points[at + 1], np.zeros(len(at), np.uint32)
            more = at + 2 < n
            more[more] = ~first[at[more] + 2]
            two[more] = points[at[more] + 2]
            short = np.isin(one, [ord(c) for c in "stmd"])
            long = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
            start[at[short | long] + 1] = False
            over = np.concatenate([at[short] + 2, at[long] + 3])
            start[over[over < n]] = True
    return start


class PieceCache:
    """Encodes texts; pieces seen before are not encoded again. encode: pieces -> (ids, number of ids of each)."""

    def __init__(self, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], limit: int = 1_000_000):
        self.encode, self.limit = encode, limit
        self.clear()

    def clear(self) -> None:
        self.keys, self.at, self.size = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.ids = np.zeros(0, np.uint32)

    def add(self, keys: np.ndarray, pieces: list[str]) -> None:
        ids, size = self.encode(pieces)
        at = len(self.ids) + np.cumsum(size, dtype=np.int64) - size
        order = np.argsort(keys)
        where = np.searchsorted(self.keys, keys[order])
        self.keys = np.insert(self.keys, where, keys[order])
        self.at, self.size = np.insert(self.at, where, at[order]), np.insert(self.size, where, size[order])
        self.ids = np.concatenate([self.ids, ids.astype(np.uint32)])

    def run(self, blocks: list[list[str]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each block of texts: all ids one after the other, and the number of ids of each text."""
        import pandas as pd

        if len(self.keys) > self.limit:
            self.clear()
        plans, new_keys, new_pieces = [], [], []
        for texts in blocks:
            joined = "".join(texts)
            sizes = np.fromiter(map(len, texts), np.int64, len(texts))
            begin = np.cumsum(sizes) - sizes
            points = code_points(joined)
            first = np.zeros(len(points), bool)
            first[begin[sizes > 0]] = True
            starts = np.flatnonzero(piece_starts(points, first))
            ends = np.append(starts[1:], len(points)) if len(starts) else starts
            codes, uniques = pd.factorize(span_hashes(points, starts, ends))
            plans.append((codes.astype(np.int32), uniques, np.searchsorted(starts, begin), len(starts)))
            found = np.searchsorted(self.keys, uniques)
            known = np.zeros(len(uniques), bool)
            ok = found < len(self.keys)
            known[ok] = self.keys[found[ok]] == uniques[ok]
            if not known.all():
                where = np.zeros(len(uniques), np.int64)
                where[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)  # the first place of each
                where = where[~known]
                new_keys.append(uniques[~known])
                new_pieces += [joined[a:b] for a, b in zip(starts[where].tolist(), ends[where].tolist(), strict=True)]
        if new_keys:
            keys, place = np.unique(np.concatenate(new_keys), return_index=True)
            self.add(keys, [new_pieces[i] for i in place.tolist()])
        del new_keys, new_pieces
        for codes, uniques, doc_at, n in plans:
            entry = np.searchsorted(self.keys, uniques)[codes]
            size = self.size[entry].astype(np.int64)
            total = np.concatenate([[0], np.cumsum(size)])
            ids = self.ids[np.repeat(self.at[entry] - total[:-1], size) + np.arange(total[-1])]
            upto = total[np.append(doc_at, n)]
            yield ids, np.diff(upto)


def text_blocks(texts: list[str], block_chars: int = BLOCK_CHARS) -> Iterator[list[str]]:
    """texts in order, in lists of about block_chars code points; a longer text is a list of its own."""
    out, n = [], 0
    for text in texts:
        if out and n + len(text) > block_chars:
            yield out
            out, n = [], 0
        out.append(text)
        n += len(text)
    if out:
        yield out


def encoded_rows(batches, cache: PieceCache, text_at: int, flush_chars: int = FLUSH_CHARS):
    """For an iterator of Arrow batches: (batch columns but the text as lists, ids, number of ids) of each
    block of rows. Rows wait until their texts have flush_chars code points, or the batches end."""
    waiting, n = [], 0

    def flush():
        blocks, rows = [], []
        for batch in waiting:
            texts = [x or "" for x in batch.column(text_at).to_pylist()]
            done = 0
            for block in text_blocks(texts):
                blocks.append(block)
                rows.append(batch.slice(done, len(block)))
                done += len(block)
        for row, block, (ids, sizes) in zip(rows, blocks, cache.run(blocks), strict=True):
            yield row, block, ids, sizes

    for batch in batches:
        waiting.append(batch)
        n += batch.column(text_at).nbytes
        if n >= flush_chars:
            yield from flush()
            waiting, n = [], 0
    if waiting:
        yield from flush()
