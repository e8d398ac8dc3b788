"""Cross-tokenizer alignment by a dictionary of groups.

A text is encoded by two tokenizers, A (byte-level BPE) and B (pieces with byte fallback). Byte offsets at which tokens of
both end cut the tokens into groups; within a group, an A and a B token are linked if their byte ranges overlap.

(1) Texts are read in blocks. A block interns its distinct units (a unit is a space and the word after it, at which
neither tokenizer merges across), encodes each once, and interns the distinct groups of A ids and B ids that units are
made of. Links are expanded once for each distinct group of a block, and counted for its pairs of ids: in how many of
the block's documents a pair is linked, each document once. The block is written as small rows: one for each document with its
numbers of groups, one for each distinct group, one for each pair count. (2) Pair counts are summed over blocks, and each A
id gets its highest count. (3) The distinct groups of all blocks are the dictionary: their links are expanded once, take
the counts, and are summed to three numbers a group. (4) These join back to the groups of blocks, and in partitions sorted by
block, where the groups of a block come before its documents, each document adds up those of its groups, times how often they
occur. A document is in one block, so no count is taken twice; texts are not shuffled, and what travels is one row for each
document and at most one for each distinct group or pair of a block, however often it occurs. No row holds more than one
document, so memory does not depend on how many blocks a task has.

Units: texts are cut before a single space between two characters that are not white space. A's pattern starts a new piece
there; no piece of B's vocabulary goes on past a space (this is checked when the model is loaded), so ids of a text are
those of its units, and groups never cross them.

Cases: a null or empty text has no tokens (zeros, digest ''), nor has one whose bytes either tokenizer does not give back
(such as a text with U+2581); strings of special tokens are plain text; a null doc_id passes through; rows that share an
id, and repeated rows, are documents of their own in counts; very long texts are encoded whole (a block of their
own); an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written
from .wordarrays import gathered

#: Bytes of text of a block.
BLOCK = 5_000_000
#: Python's white space holds all that the tokenizers take for it, so a cut is never inside a run of white space.
CUT = re.compile(r"(?<=\S)(?= \S)")
WORD_START = "▁"  # U+2581 stands for a space in B's pieces

#: Units of the documents that are put together at a time; a block has most of a million.
SLICE = 50_000
#: What a row of a written block is, in the order in which the last step reads them.
KEY, PAIR, DOCUMENT = 0, 1, 2

PARTS = pa.schema([
    ("block", pa.int64()), ("kind", pa.int32()), ("at", pa.int32()), ("key", pa.string()), ("a", pa.int32()), ("b", pa.int32()), ("n", pa.int64()), ("doc_id", pa.int64()),
    ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("groups", pa.binary()), ("digest", pa.string()),
])
PARTS_DDL = "block long, kind int, at int, key string, a int, b int, n long, doc_id long, n_a long, n_b long, n_groups long, groups binary, digest string"


def _byte_letters() -> dict[str, int]:
    """Byte-level BPE writes each byte as a letter: printable ones as themselves, others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


class Pair:
    """Both tokenizers of a worker, and the bytes of their ids."""

    def __init__(self, a_path: str, b_path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        letters = _byte_letters()
        vocab = self.a.get_vocab(with_added_tokens=False)
        # an added token is no entry of the vocabulary; as no text gives its id, its bytes are not asked for
        self.a_bytes = [b""] * (1 + max(vocab.values()))
        for token, i in vocab.items():
            self.a_bytes[i] = bytes(letters.get(c, 0) for c in token)
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        pieces = [self.b.id_to_piece(i) for i in range(len(self.b))]
        if any(WORD_START in p.lstrip(WORD_START) for p in pieces):
            raise ValueError("pieces of the second tokenizer go on past a space")
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(WORD_START, " ").encode() for i, p in enumerate(pieces)]
        self.a_sizes, self.b_sizes = (np.array([len(x) for x in table]) for table in (self.a_bytes, self.b_bytes))

    def encoded(self, units: list[str]) -> tuple[np.ndarray, ...]:
        """The number of groups of each unit (a space and what follows it; -1 if its tokens do not give its bytes back); the
        A ids and the B ids of all units one after the other; the number of A ids and of B ids of each group. No unit
        but the last ends with white space, so both tokenizers cut the joined units where units meet, and one
        call encodes them."""
        text, sizes = "".join(units), [len(u.encode()) for u in units]
        ids_a = np.asarray(self.a.encode(text, add_special_tokens=False).ids, np.int64)
        ids_b = np.asarray(self.b.encode(text[1:], num_threads=1), np.int64)
        raw = text.encode()
        if b"".join([self.a_bytes[i] for i in ids_a.tolist()]) != raw or b"".join([self.b_bytes[i] for i in ids_b.tolist()]) != raw:
            if len(units) == 1:
                return np.array([-1]), *[np.zeros(0, np.int64)] * 4
            return tuple(map(np.concatenate, zip(*[self.encoded([u]) for u in units], strict=True)))
        # where tokens of both end, a group ends
        ends_a, ends_b = np.cumsum(self.a_sizes[ids_a]), np.cumsum(self.b_sizes[ids_b])
        common = np.intersect1d(ends_a, ends_b, assume_unique=True)
        ends = np.cumsum(sizes)
        last = np.searchsorted(common, ends)
        if (common[last] != ends).any():
            raise ValueError("a token goes on past a space")
        n_a, n_b = (np.diff(np.searchsorted(x, common), prepend=-1) for x in (ends_a, ends_b))
        return np.diff(last, prepend=-1), ids_a, ids_b, n_a, n_b

    def links(self, a: tuple[int, ...], b: tuple[int, ...]) -> list[tuple[int, int]]:
        """The (A id, B id) of all tokens of a group whose byte ranges overlap."""
        out, i, j = [], 0, 0
        a_to, b_to = len(self.a_bytes[a[0]]), len(self.b_bytes[b[0]])
        while True:
            out.append((a[i], b[j]))
            low = min(a_to, b_to)
            if a_to == low:
                i += 1
                a_to += len(self.a_bytes[a[i]]) if i < len(a) else 0
            if b_to == low:
                j += 1
                b_to += len(self.b_bytes[b[j]]) if j < len(b) else 0
            if i == len(a) or j == len(b):
                return out


@lru_cache(maxsize=2)
def _pair(a_path: str, b_path: str) -> Pair:
    return Pair(a_path, b_path)


def interned(ids_a: np.ndarray, ids_b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> tuple[np.ndarray, list[tuple]]:
    """Numbers of groups that are given one after the other, equal ones having one number, and the distinct groups. A group
    is dictionary-encoded as the bytes of its size of A and all of its ids, so the comparison is exact."""
    starts = _starts(1 + n_a + n_b)
    flat = np.empty(int(starts[-1]), "<u4")
    flat[starts[:-1]] = n_a
    flat[np.repeat(starts[:-1] + 1 - (np.cumsum(n_a) - n_a), n_a) + np.arange(len(ids_a))] = ids_a
    flat[np.repeat(starts[:-1] + 1 + n_a - (np.cumsum(n_b) - n_b), n_b) + np.arange(len(ids_b))] = ids_b
    words = pa.Array.from_buffers(pa.large_binary(), len(n_a), [None, pa.py_buffer((4 * starts).tobytes()), pa.py_buffer(flat.tobytes())])
    encoded = words.dictionary_encode()
    distinct = [np.frombuffer(x, "<u4").tolist() for x in encoded.dictionary.to_pylist()]
    return encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64), [(tuple(x[1 : 1 + x[0]]), tuple(x[1 + x[0] :])) for x in distinct]


def key_of(a: tuple[int, ...], b: tuple[int, ...]) -> str:
    return f"{','.join(map(str, a))}|{','.join(map(str, b))}"


def _ids(key: str) -> tuple[tuple[int, ...], tuple[int, ...]]:
    a, b = key.split("|")
    return tuple(map(int, a.split(","))), tuple(map(int, b.split(",")))


def _gathered(values: np.ndarray, starts: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lists `which` of a table of lists (values, starts with an end), and the size of each."""
    size = (starts[1:] - starts[:-1])[which]
    at = np.repeat(starts[:-1][which] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
    return values[at], size


def _starts(sizes) -> np.ndarray:
    return np.append(0, np.cumsum(np.asarray(sizes, np.int64)))


class Block:
    """The distinct units, groups and links of a block of documents."""

    def __init__(self, texts: list[str | None], pair: Pair):
        numbers: dict[str, int] = {}
        owned, units = [], []
        for text in texts:
            own = [] if not text or WORD_START in text else CUT.split(" " + text)
            owned.append(len(own))
            units += [numbers.setdefault(u, len(numbers)) for u in own]
        # units that end with white space (the last of some texts) are encoded alone, after all others
        names = sorted(numbers, key=lambda u: u[-1].isspace())
        rank = np.empty(len(names), np.int64)
        rank[[numbers[u] for u in names]] = np.arange(len(names))
        cut = sum(not u[-1].isspace() for u in names)
        chunks = [names[at : min(at + 4096, cut)] for at in range(0, cut, 4096)] + [[u] for u in names[cut:]]
        found = [pair.encoded(chunk) for chunk in chunks]
        n_groups, *parts = map(np.concatenate, zip(*found, strict=True)) if found else [np.zeros(0, np.int64)] * 5
        unit_groups, self.groups = interned(*parts)
        bad = n_groups < 0
        units, owned = rank[np.asarray(units, np.int64)], np.asarray(owned, np.int64)
        doc = np.repeat(np.arange(len(texts)), owned)
        lost = np.zeros(len(texts), bool)
        lost[doc[bad[units]]] = True  # a text that does not come back has no tokens
        self.units = units[~lost[doc]]
        self.sizes = np.where(lost, 0, owned)
        self.unit_starts = _starts(np.maximum(n_groups, 0))
        self.unit_groups = unit_groups
        self.keys = [key_of(*g) for g in self.groups]
        self.lengths = np.asarray([(len(a), len(b)) for a, b in self.groups], np.int64).reshape(-1, 2)
        self.pair = pair

    def slices(self) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """The documents in slices of about SLICE units: first and last (not included), their groups one after the other, and the
        number of each document's. The groups of a whole block are millions."""
        ends = _starts(self.sizes)
        at = 0
        while at < len(self.sizes):
            to = max(at + 1, int(np.searchsorted(ends, ends[at] + SLICE, "right")) - 1)
            groups, size = _gathered(self.unit_groups, self.unit_starts, self.units[ends[at] : ends[to]])
            yield at, to, groups, np.diff(_starts(size)[ends[at : to + 1] - ends[at]])
            at = to


class PairCounts:
    """In how many documents of a block each pair of ids is linked: links are expanded once a group, documents as distinct groups."""

    def __init__(self, block: Block):
        self.pairs: dict[tuple[int, int], int] = {}
        of_group = [sorted({self.pairs.setdefault(x, len(self.pairs)) for x in block.pair.links(a, b)}) for a, b in block.groups]
        self.starts, self.flat = _starts([len(x) for x in of_group]), np.asarray([y for x in of_group for y in x], np.int64)
        self.counts = np.zeros(len(self.pairs), np.int64)

    def add(self, groups: np.ndarray, sizes: np.ndarray) -> None:
        n_groups, n_pairs = max(1, len(self.starts) - 1), max(1, len(self.pairs))
        own = np.unique(np.repeat(np.arange(len(sizes)), sizes) * n_groups + groups)
        linked, size = _gathered(self.flat, self.starts, own % n_groups)
        own = np.unique(np.repeat(own // n_groups, size) * n_pairs + linked)
        self.counts += np.bincount(own % n_pairs, minlength=len(self.pairs))


def _rows(size: int, /, **columns) -> pa.RecordBatch:
    """A batch of PARTS; columns that are not given are null."""
    arrays = {name: x if isinstance(x, pa.Array) else pa.array(x, PARTS.field(name).type) for name, x in columns.items()}
    return pa.record_batch([arrays[f.name] if f.name in arrays else pa.nulls(size, f.type) for f in PARTS], schema=PARTS)


def _blocks(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """Rows of PARTS: the groups of each block (KEY), its pair counts (PAIR) and its documents as numbers of groups (DOCUMENT)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        pair, task = _pair(a_path, b_path), TaskContext.get().partitionId() << 32
        for i, batch in enumerate(gathered(batches, 1, BLOCK)):
            block = Block(batch.column(1).to_pylist(), pair)
            own, counts = np.full(max(len(batch), len(block.keys)), task + i), PairCounts(block)
            for at, to, groups, sizes in block.slices():
                counts.add(groups, sizes)
                ends = _starts(sizes)
                raw, bounds, digests = groups.astype("<u4").tobytes(), (4 * ends).tolist(), []
                for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                    joined = ";".join([block.keys[g] for g in groups[a:b].tolist()])
                    digests.append(hashlib.sha256(joined.encode()).hexdigest() if b > a else "")
                n_a, n_b = (_added(x, groups, ends) for x in block.lengths.T)
                yield _rows(
                    to - at, block=own[at:to], kind=np.full(to - at, DOCUMENT), doc_id=batch.column(0).slice(at, to - at), n_a=n_a, n_b=n_b, n_groups=sizes,
                    groups=[raw[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)], digest=digests,
                )
            n = len(block.keys)
            yield _rows(n, block=own[:n], kind=np.full(n, KEY), at=np.arange(n), key=block.keys)
            pairs = np.asarray(list(counts.pairs), np.int64).reshape(-1, 2)[counts.counts > 0]
            yield _rows(len(pairs), kind=np.full(len(pairs), PAIR), a=pairs[:, 0], b=pairs[:, 1], n=counts.counts[counts.counts > 0])
            del block, counts

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, PARTS_DDL)


def _added(column: np.ndarray, groups: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The sum of a column of groups over the groups of each document."""
    total = np.append(0, np.cumsum(column[groups]))
    return total[ends[1:]] - total[ends[:-1]]


def pair_counts(blocks: DataFrame) -> DataFrame:
    """a, b, n (documents that hold the pair linked), best (whether n is the highest of the A id) of all pairs."""
    pairs = blocks.filter(F.col("kind") == PAIR).groupBy("a", "b").agg(F.sum("n").alias("n"))
    pairs = written(pairs)
    top = pairs.groupBy("a").agg(F.max("n").alias("top"))
    return pairs.join(top, "a").select("a", "b", "n", (F.col("n") == F.col("top")).alias("best"))


def _dictionary(keys: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """key, a, b, m: the links of each distinct group, m of the same two ids; expanded once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = _pair(a_path, b_path)
        for batch in batches:
            out: dict[tuple[str, int, int], int] = {}
            for key in batch.column(0).to_pylist():
                for a, b in pair.links(*_ids(key)):
                    out[key, a, b] = out.get((key, a, b), 0) + 1
            own, a, b = zip(*out, strict=True) if out else ((), (), ())
            yield pa.record_batch([pa.array(own, pa.string()), pa.array(a, pa.int32()), pa.array(b, pa.int32()), pa.array(list(out.values()), pa.int64())], names=["key", "a", "b", "m"])

    return keys.mapInArrow(run, "key string, a int, b int, m long")


def digest_documents(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every row."""
    blocks = written(_blocks(docs, a_path, b_path))
    used = blocks.filter(F.col("kind") == KEY).select("block", "kind", "at", "key")
    links = _dictionary(used.select("key").distinct(), a_path, b_path)
    scored = links.join(pair_counts(blocks), ["a", "b"])
    one = scored.groupBy("key").agg(
        F.sum("m").alias("links"), F.sum(F.when(F.col("best"), F.col("m")).otherwise(0)).alias("best"), F.sum(F.col("m") * F.col("n")).alias("count")
    )
    # a block's groups come before its documents; both are rows of small size, so no batch holds more than some thousand documents
    values = used.join(one, "key").select("block", "kind", "at", "links", "best", "count")
    documents = blocks.filter(F.col("kind") == DOCUMENT).select("block", "kind", "doc_id", "n_a", "n_b", "n_groups", "groups", "digest")
    both = values.unionByName(documents, allowMissingColumns=True).repartition("block").sortWithinPartitions("block", "kind")
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, held, table = None, [], None
        for batch in batches:
            block, kind = (batch.column(c).to_numpy() for c in ("block", "kind"))
            cuts = np.flatnonzero((block[1:] != block[:-1]) | (kind[1:] != kind[:-1])) + 1
            for first, last in zip([0, *cuts.tolist()], [*cuts.tolist(), len(batch)], strict=True):
                if first == last:
                    continue
                if block[first] != own:
                    own, held, table = block[first], [], None
                part = batch.slice(first, last - first)
                if kind[first] == KEY:
                    held.append(np.column_stack([part.column(c).to_numpy() for c in ("at", "links", "best", "count")]))
                    continue
                if table is None:
                    rows = np.concatenate([*held, np.zeros((0, 4), np.int64)])
                    table = np.zeros((3, int(rows[:, 0].max(initial=-1)) + 1), np.int64)
                    table[:, rows[:, 0]] = rows[:, 1:].T
                for at in range(0, len(part), 128):
                    piece = part.slice(at, 128)
                    groups = np.frombuffer(b"".join(piece.column("groups").to_pylist()), "<u4")
                    ends = _starts(piece.column("n_groups").to_numpy())
                    columns = [piece.column(c) for c in names[:4]] + [pa.array(_added(x, groups, ends)) for x in table] + [piece.column("digest")]
                    yield pa.record_batch(columns, names=names)

    return both.mapInArrow(run, ", ".join([f"{c} long" for c in names[:-1]] + ["groups_sha256 string"]))
