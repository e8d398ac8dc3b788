"""SimHash near-duplicate detection with pigeonring filtering.

Fingerprints: the majority bit, over all 3-word shingles of the lower-cased text, of their XXH64 (seed 42).
Two documents link if their fingerprints differ in `bits` bits or fewer; components follow links.

Pigeonring: the 64 bits are `segments` segments in a ring. If two fingerprints differ in at most `bits` bits, then from
some segment on, the differences of every chain of l segments stay within floor(bits * l / segments). The
first segments of such a chain have budget 0, so they are equal: they are the key of an equi-join (7 segments
and 2 bits: three segments, 27 bits, seven keys a fingerprint). The longer prefixes of the chain are checked in
the join condition, the whole ring last, which is the full Hamming check. All on distinct fingerprints, so
exact copies, however many, are one vertex.

Crowded keys: a key with more than `crowd` fingerprints is not joined by itself, as that would test all pairs of them. (A
smaller key is: half of `crowd` tests a fingerprint at most, each a few instructions, cost less than the up to 76 rows
that a fingerprint of a crowded key sends.)
The chain goes on instead to the last segment whose budget is 2 (7 segments and 2 bits: the whole ring; 13 and 4: nine segments, 44
bits). Two fingerprints that differ there in two bits or fewer meet where the one has the higher of these bits flipped and
the other the lower, so both sides send these bits as they are and with each of the free ones flipped, and the equi-join
is over all of them; each pair meets once a key. The chain's budgets are checked in the join condition, the whole
ring last, so only links leave the join, and no link is lost, for any number of bits. Links are not thinned: a group of
near copies with many different fingerprints within `bits` bits of each other has links with the square of its size.

Cases: a null or empty text, or one without words, has fingerprint zero and is linked as any other; of one or two
words the whole sequence is the only shingle; null doc_ids take part and name no component unless all ids in
it are null (component null); repeated rows share a fingerprint, and keep_one() tells rows apart by their own numbers;
very long texts are read whole; an empty table gives an empty table; extra columns of any name pass through keep_one().
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import checkpointed, fresh, written
from .graphs import components

SEED, SHINGLE = 42, 3
_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)
_PLACE = (np.arange(8) * 256)[None, :]


def fingerprint(text: str | None, width: int = SHINGLE, piece: int = 200_000) -> int:
    """The fingerprint of one text as an unsigned number; shingles are hashed `piece` at a time."""
    import xxhash

    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined, n = b" ".join(words), max(1, len(words) - width + 1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.append(0, ends[:-1] + 1)
    digest, counts = xxhash.xxh64_intdigest, np.zeros((8, 8), np.int64)
    for at in range(0, n, piece):
        a, b = starts[at : min(n, at + piece)].tolist(), ends[width - 1 + at : min(n, at + piece) + width - 1].tolist() if len(words) >= width else [len(joined)]
        hashes = np.fromiter((digest(joined[x:y], SEED) for x, y in zip(a, b, strict=True)), np.uint64, len(a))
        cells = np.bincount((hashes.view(np.uint8).reshape(-1, 8) + _PLACE).ravel(), minlength=2048).reshape(8, 256)
        counts += cells @ _BITS
    return int.from_bytes(np.packbits((2 * counts > n).ravel(), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp long) of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = np.array([fingerprint(t) for t in batch.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.record_batch([batch.column(0), pa.array(own)], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fp long")


def ring(segments: int, bits: int) -> tuple[list[int], list[int]]:
    """Offsets of the segments (and 64 at the end), and the budget of chains of 1, 2, ... segments."""
    return [64 * i // segments for i in range(segments + 1)], [bits * n // segments for n in range(1, segments + 1)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _mask(start: int, n: int) -> int:
    """n bits from start on, around the ring, as a signed 64-bit number."""
    return _signed(sum(1 << ((start + i) % 64) for i in range(n)))


def _differences(a: Column, b: Column, mask: int) -> Column:
    return F.bit_count(a.bitwiseXOR(b).bitwiseAND(F.lit(mask)))


def candidates(distinct: DataFrame, bits: int = 2, segments: int = 7, crowd: int = 1_024) -> DataFrame:
    """distinct: (fp), each once. Pairs (a, b), a < b, possibly repeated, that a chain of segments lets through; among them are
    all pairs within `bits` bits."""
    if not 0 <= bits < segments:
        raise ValueError("there must be more segments than bits")
    offsets, budget = ring(segments, bits)
    lead = sum(b == 0 for b in budget)  # segments that must be equal
    reach = max(n for n in range(1, segments + 1) if budget[n - 1] <= 2)  # segments with two differences at most

    def end(i: int, n: int) -> int:
        return offsets[i + n] - offsets[i] if i + n <= segments else 64 - offsets[i] + offsets[i + n - segments]

    masks = [[_mask(offsets[i], end(i, n)) for n in range(1, segments + 1)] for i in range(segments)]
    keys = F.array(*[F.struct(F.lit(i).alias("i"), F.col("fp").bitwiseAND(F.lit(masks[i][lead - 1])).alias("key")) for i in range(segments)])
    keyed = distinct.select("fp", F.explode(keys).alias("k")).select("fp", "k.i", "k.key")
    crowded = keyed.groupBy("i", "key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > crowd)
    crowded = checkpointed(crowded.select("i", "key"))

    def chain(x: Column, y: Column, i: Column, known: int) -> Column:
        """Longer chains than the `known` segments, that the key has seen to; the whole ring is the last."""
        found = F.lit(False)
        for at in range(segments):
            own = i == at
            for n in range(known + 1, segments + 1):
                if n == segments or budget[n] > budget[n - 1]:  # shorter chains of the same budget follow
                    own = own & (_differences(x, y, masks[at][n - 1]) <= budget[n - 1])
            found = found | own
        return found

    rest = keyed.join(crowded, ["i", "key"], "left_anti")
    a, b = rest.alias("a"), rest.alias("b")
    x, y = F.col("a.fp"), F.col("b.fp")
    pairs = a.join(b, (F.col("a.i") == F.col("b.i")) & (F.col("a.key") == F.col("b.key")) & (x < y) & chain(x, y, F.col("a.i"), lead))
    pairs = pairs.select(x.alias("a"), y.alias("b"))
    # the key of `reach` segments, as it is (place 0) and with each of the free bits flipped, in order of their places
    full = F.element_at(F.array(*[F.lit(masks[i][reach - 1]) for i in range(segments)]), F.col("i") + 1)
    free = [[_signed(1 << ((offsets[i] + k) % 64)) for k in range(end(i, lead), end(i, reach))] if budget[reach - 1] else [] for i in range(segments)]
    flips = F.element_at(F.array(*[F.array(F.lit(0).cast("long"), *[F.lit(x) for x in own]) for own in free]), F.col("i") + 1)
    inside = keyed.join(crowded, ["i", "key"], "left_semi").select("fp", "i", F.col("fp").bitwiseAND(full).alias("long"))
    sent = inside.select("fp", "i", F.posexplode(F.transform(flips, lambda z: F.col("long").bitwiseXOR(z))).alias("place", "long"))
    a, b = sent.alias("a"), sent.filter(F.col("place") == 0).alias("b") if budget[reach - 1] < 2 else sent.alias("b")
    turn = (F.col("b.place") < F.col("a.place")) | ((F.col("a.place") == 0) & (F.col("b.place") == 0))
    near = a.join(b, (F.col("a.i") == F.col("b.i")) & (F.col("a.long") == F.col("b.long")) & (x < y) & turn & chain(x, y, F.col("a.i"), lead))
    near = near.select(x.alias("a"), y.alias("b"))
    return pairs.union(near)


def links(distinct: DataFrame, bits: int = 2, segments: int = 7, crowd: int = 1_024) -> DataFrame:
    """All pairs (a, b), a < b, of fingerprints within `bits` bits, each once."""
    found = candidates(distinct, bits, segments, crowd)
    return found.filter(_differences(F.col("a"), F.col("b"), -1) <= bits).distinct()


def _labelled(distinct: DataFrame, bits: int, segments: int, crowd: int) -> DataFrame:
    """distinct: (fp, least). (fp, component): the smallest `least` that is reachable, nulls last."""
    labels = components(links(distinct.select("fp"), bits, segments, crowd))
    named = distinct.join(labels.withColumnRenamed("v", "fp"), "fp", "left")
    linked = named.filter(F.col("label").isNotNull())
    least = linked.groupBy("label").agg(F.min("least").alias("component"))
    linked = linked.select("fp", "label").join(least, "label").select("fp", "component")
    return linked.union(named.filter(F.col("label").isNull()).select("fp", F.col("least").alias("component")))


def classes(docs: DataFrame, bits: int = 2, segments: int = 7, crowd: int = 1_024) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (the smallest doc_id reachable) of every document."""
    marked = written(fingerprints(docs))
    distinct = written(marked.groupBy("fp").agg(F.min("doc_id").alias("least")))
    table = _labelled(distinct, bits, segments, crowd)
    return marked.join(table, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def keep_one(docs: DataFrame, bits: int = 2, segments: int = 7, crowd: int = 1_024) -> DataFrame:
    """One row of each component: that of the smallest doc_id, nulls last; among rows that share it, the first as read."""
    row, fp = fresh(*docs.columns, base="_row"), fresh(*docs.columns, base="_fp")
    columns = docs.columns
    numbered = docs.withColumn(row, F.monotonically_increasing_id())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
            yield batch.append_column(fp, pa.array(np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64)))

    marked = written(numbered.mapInArrow(run, T.StructType([*numbered.schema.fields, T.StructField(fp, T.LongType())])))
    # as structs are compared field by field and nulls come first: whether there is an id, the id, the row
    place = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").cast("long").alias("id"), F.col(row).alias("row"))
    distinct = written(marked.groupBy(F.col(fp).alias("fp")).agg(F.min(place).alias("least")))
    name = fresh(*columns, base="_stay")
    stay = _labelled(distinct, bits, segments, crowd).select(F.col("component.row").alias(name)).distinct()
    return marked.join(stay, F.col(row) == F.col(name), "left_semi").select(*columns)
