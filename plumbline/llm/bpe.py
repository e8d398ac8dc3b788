"""Byte-level BPE by corpus-level merge replay.

Instead of merging inside one word at a time, the distinct words of a large block of the corpus are laid out
in one array. An inverted index holds, for each merge rank, the positions where that pair now stands, over all
words. Ranks are taken in order from a heap; one step replaces the pair in every word that has it (its
leftmost place), relinks neighbours, and enters only the pairs of the touched neighbours into the index.
A pair can get a lower rank than the merge that made it; the heap then takes that next, which is the order
in which a single word would be merged, so ids equal those of the word-by-word method.

Blocks: a task lays out the new words of up to FLUSH_CHARS code points of its texts at a time and keeps a
bounded table of words already replayed, so memory has a bound and no word list of the whole corpus is
broadcast or shuffled. Texts do not move: encoding is a narrow map.

Cases: a null or empty text has no ids; every text is encoded whole; repeated rows are encoded alike;
special-token strings are ordinary text; other columns pass through unless they clash with an output name.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .pieces import PieceCache, encoded_rows

NONE = np.iinfo(np.int32).max


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: a base64 token and its rank in each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class MergeReplay:
    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        pairs = {}
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                a, b = ranks.get(token[:i]), ranks.get(token[i:])
                if a is not None and b is not None:
                    pairs[a << 32 | b] = rank
        keys = np.fromiter(pairs, np.int64, len(pairs))
        order = np.argsort(keys)
        self.keys, self.rank = keys[order], np.fromiter(pairs.values(), np.int32, len(pairs))[order]
        self.byte = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token

    def pair_rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a.astype(np.int64) << 32 | b
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == key, self.rank[at], NONE)

    def encode(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all pieces one after the other, and how many each has."""
        words = [p.encode() for p in pieces]
        whole = np.fromiter((self.ranks.get(w, -1) for w in words), np.int64, len(words))
        rest = np.flatnonzero(whole < 0)
        ids, sizes = self.replay([words[i] for i in rest.tolist()])
        size = np.ones(len(words), np.int32)
        size[rest] = sizes
        at = np.cumsum(size) - size
        out = np.zeros(int(size.sum()), np.uint32)
        out[at[whole >= 0]] = whole[whole >= 0]
        begin = np.cumsum(sizes) - sizes
        out[np.repeat(at[rest] - begin, sizes) + np.arange(len(ids))] = ids
        return out, size

    def replay(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        lens = np.fromiter(map(len, words), np.int64, len(words))
        n = int(lens.sum())
        if not n:
            return np.zeros(0, np.int32), lens.astype(np.int32)
        # one slot more than positions stands for "no neighbour"
        token = np.append(self.byte[np.frombuffer(b"".join(words), np.uint8)], 0).astype(np.int32)
        word = np.repeat(np.arange(len(words), dtype=np.int32), lens)
        after, before = np.arange(1, n + 2, dtype=np.int32), np.arange(-1, n, dtype=np.int32)
        begins = (np.cumsum(lens) - lens)[lens > 0]
        before[begins] = n
        after[np.append(begins[1:] - 1, n - 1)] = n
        alive = np.ones(n, bool)
        rank = np.append(np.where(after[:n] == n, NONE, self.pair_rank(token[:n], token[after[:n]])), NONE).astype(np.int32)
        index: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def enter(places: np.ndarray, ranks: np.ndarray) -> None:
            order = np.argsort(ranks, kind="stable")
            places, ranks = places[order], ranks[order]
            cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
            for r, part in zip(ranks[np.append(0, cuts)].tolist(), np.split(places, cuts), strict=True):
                if r in index:
                    index[r].append(part)
                else:
                    index[r] = [part]
                    heapq.heappush(heap, r)

        places = np.flatnonzero(rank[:n] != NONE).astype(np.int32)
        if len(places):
            enter(places, rank[places])
        while heap:
            r = heapq.heappop(heap)
            parts = index.pop(r)
            at = parts[0] if len(parts) == 1 else np.concatenate(parts)
            at = at[rank[at] == r]
            if not len(at):
                continue
            if len(at) > 1:
                at = np.sort(at)
                own = word[at]
                lead = np.append(True, own[1:] != own[:-1])
                if not lead.all():
                    later = at[~lead]
                    index[r] = [later]
                    heapq.heappush(heap, r)
                    at = at[lead]
            gone = after[at]
            token[at] = r
            right = after[gone]
            after[at] = right
            before[right] = at
            alive[gone] = False
            rank[gone] = NONE
            left = before[at]
            touched = np.concatenate([at[right != n], left[left != n]])
            rank[at] = NONE
            new = self.pair_rank(token[touched], token[after[touched]])
            rank[touched] = new
            real = new != NONE
            if real.any():
                enter(touched[real], new[real])
        counts = np.bincount(word[alive], minlength=len(words))
        return token[:n][alive], counts.astype(np.int32)

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


@lru_cache(maxsize=2)
def _worker(path: str) -> tuple[MergeReplay, PieceCache]:
    """One table of words per Python worker, kept across its tasks."""
    replay = MergeReplay(read_ranks(path))
    return replay, PieceCache(replay.encode)


def encode_documents(docs: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, ids array<int>): the ids of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, cache = _worker(path)
        for rows, _, ids, sizes in encoded_rows(batches, cache, 1):
            lists = pa.ListArray.from_arrays(np.append(0, np.cumsum(sizes)).astype(np.int32), ids.astype(np.int32))
            yield pa.record_batch([rows.column(0), lists], names=[id_column, "ids"])

    thin = docs.select(id_column, text_column)
    kind = thin.schema[id_column].dataType.simpleString()
    return thin.mapInArrow(run, f"`{id_column}` {kind}, ids array<int>")


def digest_documents(
    docs: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text", with_ids: bool = False
) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, and ids if asked for): every whole text is encoded and its
    ids decoded again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        replay, cache = _worker(path)
        written = [str(i).encode() for i in range(len(replay.tokens))]
        for rows, _, ids, sizes in encoded_rows(batches, cache, 1):
            ids_hex, text_hex, done = [], [], 0
            for size in sizes.tolist():
                own = ids[done : done + size].tolist()
                done += size
                ids_hex.append(hashlib.sha256(b",".join(map(written.__getitem__, own))).hexdigest())
                text_hex.append(hashlib.sha256(replay.decode(own)).hexdigest())
            columns = [rows.column(0), pa.array(sizes, pa.int64()), pa.array(ids_hex, pa.string()), pa.array(text_hex, pa.string())]
            names = [id_column, "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                columns.append(pa.ListArray.from_arrays(np.append(0, np.cumsum(sizes)).astype(np.int32), ids.astype(np.int32)))
                names.append("ids")
            yield pa.record_batch(columns, names=names)

    thin = docs.select(id_column, text_column)
    kind = thin.schema[id_column].dataType.simpleString()
    schema = f"`{id_column}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return thin.mapInArrow(run, schema + (", ids array<int>" if with_ids else ""))
