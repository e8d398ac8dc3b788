"""Language identification: multinomial naive Bayes over hashed character n-grams.

A text becomes its letters in lower case with single spaces between runs of letters; its features are all
n-grams of 1 to 3 of these characters, each order hashed apart. The model is a matrix of log probabilities
(buckets x languages, 4-byte floats: 128 KB a language), broadcast to the workers. It has at most MAX_CELLS cells: with more
than 512 languages there are fewer buckets, and more than 16,384 languages are an error. A batch is scored as a sparse product:
rows of the matrix are gathered by bucket and added up by text. The score is the posterior of the language.

Training counts n-grams in parallel over a bounded sample of the labelled rows: about `rows_per_language` of each
language, chosen by a hash of the id, so rare languages keep all theirs. Only the text is used for a prediction.

Cases: a text that is null or has no letter is `und` with score 0; rows without a language are not learnt from but are
predicted; of languages that are equally likely the first by name is taken; very long texts are read whole; repeated rows are
predicted alike; without any labelled row all texts are `und`; an empty table gives an empty table; extra columns are not read.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .pieces import LETTER, STEP, char_values, class_table, code_points, mixed, text_blocks

ORDERS = (1, 2, 3)
#: Cells of the matrix at most (64 MB): what is broadcast, and what all tasks together send to the driver, does not grow.
MAX_CELLS, MIN_BUCKETS = 1 << 24, 1 << 10
UNKNOWN = "und"


@cache
def folded() -> np.ndarray:
    """For each code point its lower case if it is a letter, else a space."""
    table = np.full(0x110000, 0x20, np.uint32)
    letters = np.flatnonzero(class_table() == LETTER)
    table[letters] = [ord(x) if len(x := chr(c).lower()) == 1 else c for c in letters.tolist()]
    return table


def gram_buckets(texts: list[str], buckets: int) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """For each order, buckets and text numbers (ascending) of all n-grams; and which texts have a letter."""
    spaced = [f" {t} " for t in texts]
    points = folded()[code_points("".join(spaced))]
    text = np.repeat(np.arange(len(texts)), np.fromiter(map(len, spaced), np.int64, len(spaced)))
    blank = points == 0x20
    keep = np.ones(len(points), bool)
    keep[1:] = ~(blank[1:] & blank[:-1]) | (text[1:] != text[:-1])
    points, text = points[keep], text[keep]
    has = np.bincount(text[points != 0x20], minlength=len(texts)) > 0
    values, out = char_values()[points], []
    total, factor = np.zeros(len(points), np.uint64), 1
    for n in range(1, max(ORDERS) + 1):
        if len(points) < n:
            break
        total = total[: len(points) - n + 1] + values[n - 1 :] * np.uint64(factor)
        factor = factor * STEP % 2**64
        own = text[: len(total)]
        inside = own == text[n - 1 :]
        out.append(((mixed(total[inside] ^ np.uint64(n)) % np.uint64(buckets)).astype(np.int32), own[inside]))
    return out, has


def held_out(doc_id: Column) -> Column:
    """True for the third of documents that is never learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


class Model:
    def __init__(self, languages: list[str], matrix: np.ndarray, prior: np.ndarray):
        self.languages, self.matrix, self.prior = languages, matrix, prior

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Language and posterior of each text."""
        texts = [t or "" for t in texts]
        if not self.languages or not texts:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        grams, has = gram_buckets(texts, len(self.matrix))
        total = np.tile(self.prior, (len(texts), 1))
        for bucket, text in grams:
            if len(text):
                first = np.append(0, np.flatnonzero(text[1:] != text[:-1]) + 1)
                total[text[first]] += np.add.reduceat(self.matrix[bucket], first, axis=0, dtype=np.float64)
        best = total.argmax(1)
        score = 1 / np.exp(total - total.max(1, keepdims=True)).sum(1)
        names = [self.languages[b] if h else UNKNOWN for b, h in zip(best.tolist(), has.tolist(), strict=True)]
        return names, np.where(has, score, 0.0)


def fit(labelled: DataFrame, buckets: int = 32_768, rows_per_language: int = 2_000, smooth: float = 0.5) -> Model:
    """labelled: (doc_id, text, lang). Rows of null text or lang are left out."""
    rows = labelled.filter(F.col("text").isNotNull() & F.col("lang").isNotNull())
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row a language
    languages = sorted(sizes)
    if len(languages) * MIN_BUCKETS > MAX_CELLS:
        raise ValueError(f"{len(languages)} languages are more than a matrix of {MAX_CELLS} cells has room for")
    while buckets > MIN_BUCKETS and buckets * len(languages) > MAX_CELLS:
        buckets //= 2
    if not languages:
        return Model([], np.zeros((buckets, 0), np.float32), np.zeros(0))
    share = F.create_map(*[F.lit(x) for k in languages for x in (k, min(1.0, rows_per_language / sizes[k]))])
    chosen = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("langid")), F.lit(1 << 20)) < share[F.col("lang")] * (1 << 20)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = {k: i for i, k in enumerate(languages)}
        counts = np.zeros((len(languages), buckets), np.int64)
        for batch in batches:
            langs, done = [at[x] for x in batch.column(1).to_pylist()], 0
            for block in text_blocks(batch.column(0).to_pylist()):
                own = np.array(langs[done : done + len(block)])
                done += len(block)
                for bucket, text in gram_buckets(block, buckets)[0]:
                    counts += np.bincount(own[text] * buckets + bucket, minlength=counts.size).reshape(counts.shape)
        lang, bucket = np.nonzero(counts)
        yield pa.record_batch([pa.array(lang), pa.array(bucket), pa.array(counts[lang, bucket])], names=["lang", "bucket", "n"])

    counted = rows.filter(chosen).select("text", "lang").mapInArrow(count, "lang long, bucket long, n long")
    table = counted.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()  # at most languages x buckets rows
    counts = np.zeros((buckets, len(languages)))
    counts[table["bucket"], table["lang"]] = table["n"]
    matrix = np.log((counts + smooth) / (counts.sum(0) + smooth * buckets)).astype(np.float32)
    prior = np.log(np.array([sizes[k] for k in languages]) / sum(sizes.values()))
    return Model(languages, matrix, prior)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = 0
            for block in text_blocks([t or "" for t in batch.column(2).to_pylist()]):
                names, score = shared.value.predict(block)
                ids = batch.slice(done, len(block))
                done += len(block)
                yield pa.record_batch(
                    [ids.column(0), ids.column(1), pa.array(names, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"]
                )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")
