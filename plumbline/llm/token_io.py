"""Token-id files: frequency-ranked ids in a byte-aligned variable-length code with separate control bytes.

Writing takes three steps. (1) Documents are range-sorted by id and encoded by the tokenizers library; ids go
to a table in the shared folder, each document with its range part and its place in it. (2) Ids are counted
(one histogram a task, summed) and ranked by descending count, so frequent ids get short codes. (3) The table
is read once more and written as blocks, a narrow step without a shuffle.

A block is a byte string: header, document ids, their sizes, control bytes, data bytes. Ranks take 1 or 2
bytes if the vocabulary has up to 65,536 ids, with one control bit an id, else 1 to 4 bytes with two bits. A
control byte thus speaks for 8 or 4 ids; the decoder looks it up in a table of 256 rows of lengths and
gathers all values of a block at once. Blocks are rows of Parquet files in folders part=N; N, then the start
in the part, is ascending document order. Spark's commit protocol makes a lost executor harmless.

The tokenizer is handed each distinct piece once (see pieces): as pieces never merge across their borders, a
text's ids are the ids of its pieces one after the other. Pieces without inner white space are handed over many
at a time, with line breaks between them. A text that holds one of the tokenizer's added tokens (such as
<|endoftext|>) goes to the library whole, so it gets the id of that token, as the library's default is.

Cases: a null text is an empty document (only the end id); a null doc_id sorts first; repeated doc_ids stay
separate documents next to each other, in any number of parts; an empty table gives no blocks; very long texts are
encoded whole; other columns are not read.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import remove, shared_dir
from .pieces import WHITE_SPACE, PieceCache, encoded_rows

MAGIC = b"PLT1"
HEADER = struct.Struct("<4sBBHIIQQ")  # magic, bytes of the widest rank, 0, 0, documents, control bytes, ids, data bytes
BLOCK_IDS = 1_000_000

TOKEN_SCHEMA = "part int, start long, doc_id long, n long, ids binary"
BLOCK_SCHEMA = "part int, start long, n_docs long, n_ids long, block binary"


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    """The tokenizer and the table of pieces of this Python worker."""
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    (line,) = tok.encode("\n", add_special_tokens=False).ids
    inner = {chr(c) for c in WHITE_SPACE}

    def encode(pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        plain = [not any(c in inner for c in p.removeprefix(" ")) and p != " " for p in pieces]
        order = [i for i, ok in enumerate(plain) if ok] + [i for i, ok in enumerate(plain) if not ok]
        cut = sum(plain)
        groups = ["\n".join([pieces[i] for i in order[k : min(k + 512, cut)]]) for k in range(0, cut, 512)]
        parts = []
        for k in range(0, len(groups), 64):
            for e in tok.encode_batch_fast(groups[k : k + 64], add_special_tokens=False):
                parts += [np.asarray(e.ids, np.uint32), np.array([line], np.uint32)]
        flat = np.concatenate(parts) if parts else np.zeros(0, np.uint32)
        stops = np.flatnonzero(flat == line)
        size = np.diff(stops, prepend=-1) - 1
        flat = flat[flat != line]
        rest = [e.ids for e in tok.encode_batch_fast([pieces[i] for i in order[cut:]], add_special_tokens=False)]
        flat = np.concatenate([flat, *[np.asarray(x, np.uint32) for x in rest]])
        size = np.concatenate([size, np.fromiter(map(len, rest), np.int64, len(rest))])
        if len(size) != len(pieces):
            raise ValueError("the tokenizer does not keep pieces apart")
        # back to the order in which pieces came
        at = np.cumsum(size) - size
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        size, at = size[back], at[back]
        begin = np.cumsum(size) - size
        return flat[np.repeat(at - begin, size) + np.arange(len(flat))], size.astype(np.int32)

    added = [t.content for t in tok.get_added_tokens_decoder().values()]
    return tok, PieceCache(encode), added


def _whole(tok, added: list[str], texts: list[str], ids: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """ids and sizes with those of texts that hold an added token replaced by what the library gives for the whole
    text, as it looks for added tokens before it cuts a text into pieces."""
    own = [i for i, t in enumerate(texts) if any(a in t for a in added)]
    if not own:
        return ids, sizes
    parts = np.split(ids, np.cumsum(sizes)[:-1])
    sizes = sizes.copy()
    for i in own:
        parts[i] = np.asarray(tok.encode(texts[i], add_special_tokens=False).ids, ids.dtype)
        sizes[i] = len(parts[i])
    return np.concatenate(parts), sizes


def tokenized(docs: DataFrame, path: str, end_id: int, parts: int, width: int) -> DataFrame:
    """TOKEN_SCHEMA rows in ascending doc_id order within a part, parts in ascending order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        tok, cache, added = _tokenizer(path)
        part, start = TaskContext.get().partitionId(), 0
        for rows, texts, ids, sizes in encoded_rows(batches, cache, 1):
            ids, sizes = _whole(tok, added, texts, ids, sizes)
            ends = np.cumsum(sizes)
            ids = np.insert(ids, ends, end_id).astype(f"<u{width}")
            upto = np.append(0, np.cumsum(sizes + 1))
            data = ids.tobytes()
            binary = pa.Array.from_buffers(
                pa.binary(), len(sizes), [None, pa.py_buffer((upto * width).astype(np.int32).tobytes()), pa.py_buffer(data)]
            )
            yield pa.record_batch(
                [pa.array(np.full(len(sizes), part, np.int32)), pa.array(start + upto[:-1]), rows.column(0), pa.array(np.diff(upto)), binary],
                names=["part", "start", "doc_id", "n", "ids"],
            )
            start += int(upto[-1])

    # rows that share an id may go to any part next to each other: by their text, then by where they were read
    order = [F.col("doc_id").asc_nulls_first(), F.col("_h"), F.col("_row")]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("_h"), F.monotonically_increasing_id().alias("_row"))
    ranged = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    return ranged.select("doc_id", "text").mapInArrow(run, TOKEN_SCHEMA)


def rank_ids(tokens: DataFrame, width: int) -> np.ndarray:
    """All ids that occur, by descending count, ties by id. As many as the vocabulary has at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(0, np.int64)
        for batch in batches:
            ids = np.frombuffer(b"".join(batch.column(0).to_pylist()), f"<u{width}")
            own = np.bincount(ids, minlength=len(counts))
            own[: len(counts)] += counts
            counts = own
        found = np.flatnonzero(counts)
        yield pa.record_batch([pa.array(found), pa.array(counts[found])], names=["id", "n"])

    counts = tokens.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    counts = counts.sort_values(["n", "id"], ascending=[False, True])
    return counts["id"].to_numpy(np.int64)


def length_table(bits: int) -> np.ndarray:
    """The byte lengths that each of 256 control bytes stands for, low bits first."""
    per = 8 // bits
    return np.array([[(c >> (bits * k) & (2**bits - 1)) + 1 for k in range(per)] for c in range(256)], np.int64)


def encode_block(doc_ids: list, sizes: np.ndarray, ranks: np.ndarray, wide: bool) -> bytes:
    bits = 2 if wide else 1
    per, n = 8 // bits, len(ranks)
    size = 1 + (ranks > 0xFF).astype(np.int64)
    if wide:
        size += (ranks > 0xFFFF).astype(np.int64) + (ranks > 0xFFFFFF)
    padded = np.zeros(-(-n // per) * per, np.int64)
    padded[:n] = size - 1
    control = (padded.reshape(-1, per) << (np.arange(per) * bits)).sum(1).astype(np.uint8)
    at = np.cumsum(size) - size
    data = np.zeros(int(size.sum()), np.uint8)
    for k in range(4 if wide else 2):
        has = size > k
        data[at[has] + k] = (ranks[has] >> (8 * k)).astype(np.uint8)
    known = np.array([x is not None for x in doc_ids], np.uint8)
    ids = np.array([x or 0 for x in doc_ids], "<i8")
    head = HEADER.pack(MAGIC, 4 if wide else 2, 0, 0, len(doc_ids), len(control), n, len(data))
    return b"".join([head, known.tobytes(), ids.tobytes(), sizes.astype("<u8").tobytes(), control.tobytes(), data.tobytes()])


def decode_block(block: bytes) -> tuple[list, np.ndarray, np.ndarray]:
    """(document ids, ids in each document, ranks of all)."""
    magic, widest, _, _, n_docs, n_control, n, n_data = HEADER.unpack_from(block)
    if magic != MAGIC:
        raise ValueError("not a token block")
    at = HEADER.size
    known = np.frombuffer(block, np.uint8, n_docs, at)
    ids = np.frombuffer(block, "<i8", n_docs, at + n_docs)
    sizes = np.frombuffer(block, "<u8", n_docs, at + 9 * n_docs).astype(np.int64)
    control = np.frombuffer(block, np.uint8, n_control, at + 17 * n_docs)
    data = np.frombuffer(block, np.uint8, n_data, at + 17 * n_docs + n_control)
    bits = 2 if widest == 4 else 1
    size = length_table(bits)[control].reshape(-1)[:n]
    begin = np.cumsum(size) - size
    ranks = data[begin].astype(np.int64)
    for k in range(1, widest):
        has = np.flatnonzero(size > k)
        ranks[has] |= data[begin[has] + k].astype(np.int64) << (8 * k)
    return [i if k else None for i, k in zip(ids.tolist(), known.tolist(), strict=True)], sizes, ranks


def to_blocks(tokens: DataFrame, ranked: np.ndarray, width: int, block_ids: int = BLOCK_IDS) -> DataFrame:
    """BLOCK_SCHEMA rows: documents that follow each other in a part, about block_ids ids a block."""
    rank_of = np.zeros(int(ranked.max()) + 1 if len(ranked) else 1, np.uint32)
    rank_of[ranked] = np.arange(len(ranked))
    wide = len(ranked) > 65_536

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def block(part, start, docs, sizes, ids):
            ranks = rank_of[np.frombuffer(b"".join(ids), f"<u{width}")]
            packed = encode_block(docs, np.array(sizes, np.int64), ranks, wide)
            row = [[part], [start], [len(docs)], [len(ranks)], [packed]]
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            return pa.record_batch([pa.array(x, k) for x, k in zip(row, kinds, strict=True)], names=["part", "start", "n_docs", "n_ids", "block"])

        own: list = []  # part, start, doc ids, sizes, ids of the block being filled
        for batch in batches:
            for part, start, doc, n, ids in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if own and (own[0] != part or own[1] + own[5] != start or own[5] >= block_ids):
                    yield block(*own[:5])
                    own = []
                if not own:
                    own = [part, start, [], [], [], 0]
                own[2].append(doc)
                own[3].append(n)
                own[4].append(ids)
                own[5] += n
        if own:
            yield block(*own[:5])

    return tokens.mapInArrow(run, BLOCK_SCHEMA)


def write_tokens(docs: DataFrame, tokenizer_path: str, out: str, end_id: int = 0, vocabulary: int = 50_257) -> None:
    """Writes out/ranks and out/blocks."""
    spark = docs.sparkSession
    width = 2 if vocabulary <= 65_536 else 4
    parts = max(docs.rdd.getNumPartitions(), int(spark.conf.get("spark.sql.shuffle.partitions")))
    work = f"{shared_dir(spark)}/plumbline/{uuid.uuid4().hex}"
    tokenized(docs, tokenizer_path, end_id, parts, width).write.option("compression", "zstd").parquet(work)
    tokens = spark.read.schema(TOKEN_SCHEMA).parquet(work)
    ranked = rank_ids(tokens, width)
    table = spark.createDataFrame([(r, int(i)) for r, i in enumerate(ranked)], "rank long, id long")
    table.coalesce(1).write.parquet(f"{out}/ranks")
    blocks = to_blocks(tokens, ranked, width)
    blocks.write.option("compression", "zstd").partitionBy("part").parquet(f"{out}/blocks")
    remove(spark, work)


def read_tokens(spark: SparkSession, out: str) -> tuple[DataFrame, np.ndarray, dict[int, int]]:
    """The blocks, the id of each rank, and the ids in all parts before each part."""
    ranked = spark.read.schema("rank long, id long").parquet(f"{out}/ranks").orderBy("rank").toPandas()["id"].to_numpy(np.int64)
    blocks = spark.read.schema(BLOCK_SCHEMA).parquet(f"{out}/blocks")
    base, before = {}, 0
    for part, n in blocks.groupBy("part").agg(F.sum("n_ids")).orderBy("part").collect():  # a row for each part
        base[part], before = before, before + n
    return blocks, ranked, base


def document_digests(spark: SparkSession, out: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, read back from the files."""
    blocks, ranked, base = read_tokens(spark, out)
    ids_of = ranked.astype("<u4")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, start, block in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                docs, sizes, ranks = decode_block(block)
                data = memoryview(ids_of[ranks].tobytes())
                upto = np.append(0, np.cumsum(sizes))
                cuts = (upto * 4).tolist()
                crc = [zlib.crc32(data[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
                yield pa.record_batch(
                    [pa.array(docs, pa.int64()), pa.array(base[part] + start + upto[:-1]), pa.array(sizes), pa.array(crc, pa.int64())],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    return blocks.select("part", "start", "block").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
