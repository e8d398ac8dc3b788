"""Quality rules: base text rules, then a hashed n-gram log-likelihood ratio.

The model is two multinomials over hashed word n-grams (orders 1 and 2, counted separately): one of the
texts that the label table marks good (trusted target), one of all texts (raw corpus). A document's score
is the sum over its n-grams of log(p_target / p_raw), divided by the number of n-grams, so long and short
texts compare. The threshold is fixed before any document is judged: `threshold`, or the mean minus `spread`
standard deviations over trusted texts that the model was not fitted on. Every document is decided by
score >= threshold. All trusted documents count, half of them (by a hash of the id) for the model and half for the
threshold; the raw side counts all documents.

Everything is DataFrame code. Counting is one aggregation over n-grams made of exploded words, which Spark compiles
as a whole; it combines before its shuffle (at most `buckets` rows a task). The model is one row with an array of
`buckets` doubles (512 KB at 65,536), read as a scalar subquery, so scoring is a narrow pass without any shuffle or join.

Cases: a null text has no words, fails the base rules and has score null; an empty text likewise; repeated
rows are judged alike; labels may repeat or be null (a document counts as trusted once if any of its labels is 1);
an empty table or no trusted text gives log ratio 0 for every n-gram; very long texts are read whole (their arrays of hashes
must fit a task); columns not asked for are dropped, and those asked for may have any name.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CHARS, checkpointed, word_list

SYMBOLS = "[#*$%&|<>]"
REPEAT_WINDOW = 8
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
OUTPUT = (*BASE, "llr", "threshold", "kept")
#: Trusted ids that are broadcast at most (8 bytes each, about 60 MB in a hash table).
BROADCAST_IDS = 1_000_000


def hashed(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def paired(hashes: str, step: int = 1) -> Column:
    """The hash of each element of an array of hashes together with the one `step` places on."""
    n = F.greatest(F.size(hashes) - step, F.lit(0))
    return F.zip_with(F.slice(hashes, 1, n), F.slice(hashes, 1 + step, n), lambda x, y: F.xxhash64(x, y))


def with_grams(docs: DataFrame, words: str = "_words") -> DataFrame:
    """docs with the hashes of the words and of the pairs of neighbours: columns of their own, so that each is made once."""
    return docs.withColumn("_hashes", hashed(F.col(words))).withColumn("_pairs", paired("_hashes"))


def with_repeat_words(docs: DataFrame, pairs: str = "_pairs", width: int = REPEAT_WINDOW) -> DataFrame:
    """docs with n_repeat_words: words covered by windows of `width` (2 or more) words that occur twice or more in the
    text, the first included.

    Windows are 64-bit hashes in an array, made of those of half their width, from pairs up; most texts have as many
    distinct hashes as windows and end there. Otherwise hashes are sorted with their places, places with an equal
    neighbour kept, and their covers added up. Each step is a column of its own that later steps use more than once,
    so that it is computed once."""
    docs, span = docs.withColumn("_windows", F.col(pairs)), 2
    while span < width:
        step = min(span, width - span)
        docs, span = docs.withColumn("_windows", paired("_windows", step)), span + step
    placed = F.sort_array(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    empty = F.array().cast("array<struct<h:bigint,i:int>>")
    repeats = F.size(F.array_distinct("_windows")) < F.size("_windows")
    docs = docs.withColumn("_placed", F.when(repeats, placed).otherwise(empty))
    same = lambda x, k: F.coalesce(F.get("_placed", k)["h"] == x["h"], F.lit(False))
    twins = F.filter("_placed", lambda x, k: same(x, k - 1) | same(x, k + 1))
    places = F.sort_array(F.transform(twins, lambda x: x["i"]))
    covered = F.aggregate(
        places,
        F.struct(F.lit(0).alias("n"), F.lit(-(2**30)).alias("end")),
        lambda acc, p: F.struct(
            (acc["n"] + F.least(F.lit(width), p + width - acc["end"])).alias("n"), (p + width).alias("end")
        ),
        lambda acc: acc["n"],
    )
    return docs.withColumn("n_repeat_words", covered.cast("long")).drop("_windows", "_placed")


def with_base_rules(docs: DataFrame, words: str = "_words", pairs: str = "_pairs") -> DataFrame:
    """docs with the base columns; the arrays of words and of the hashes of pairs are columns of docs. No white space is a
    symbol, so symbols are counted in the text; the characters of words are those of all words put together."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.btrim(x, F.lit(SPACE_CHARS)) != "")
    docs = docs.withColumn("_lines", lines).withColumns(
        {
            "n_words": F.size(words).cast("long"),
            "word_chars": F.length(F.concat_ws("", words)).cast("long"),
            "n_symbols": F.regexp_count(text, F.lit(SYMBOLS)).cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        }
    ).drop("_lines")
    docs = with_repeat_words(docs, pairs)
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return docs.withColumn("base_failed", failed)


def bucket(h: Column, buckets: int, odd: int) -> Column:
    """The bucket of a gram: even ones hold words, odd ones pairs."""
    return (2 * F.pmod(h, F.lit(buckets // 2)) + odd).cast("int")


def trusted_halves(trusted: DataFrame) -> DataFrame:
    """(_t, _fit): each trusted id once, with _fit true for the half (by hash) that fits the model and false for the half
    that sets the threshold."""
    ids = trusted.select(F.col("doc_id").alias("_t")).filter(F.col("_t").isNotNull()).distinct()
    return ids.select("_t", (F.pmod(F.shiftright(F.xxhash64("_t"), 8), F.lit(2)) == 0).alias("_fit"))


def words_of(docs: DataFrame, ids: DataFrame | None = None, n_ids: int = 0) -> DataFrame:
    """(_words) of all documents, or of those with an id in ids (_t). Ids are broadcast up to BROADCAST_IDS of them; more are
    joined, and nulls do not take part in that."""
    if ids is not None:
        few = F.broadcast if n_ids <= BROADCAST_IDS else lambda df: df
        docs = docs.select("doc_id", "text").filter(F.col("doc_id").isNotNull()).join(few(ids), F.col("doc_id") == F.col("_t"), "left_semi")
    return docs.select(word_list(F.col("text")).alias("_words"))


def gram_rows(words: DataFrame, buckets: int) -> DataFrame:
    """(b): the buckets of all 1- and 2-grams. Words become rows before they are hashed, as Spark compiles what works on rows
    but evaluates functions over array elements one by one."""
    both = F.arrays_zip(F.col("_words").alias("w"), F.slice("_words", 2, F.size("_words")).alias("x"))
    rows = words.select(F.explode(both).alias("z"))
    one, two = F.xxhash64("z.w"), F.xxhash64(F.xxhash64("z.w"), F.xxhash64("z.x"))
    pair = F.when(F.col("z.x").isNotNull(), bucket(two, buckets, 1))  # the last word has none after it
    return rows.select(F.explode(F.array(bucket(one, buckets, 0), pair)).alias("b")).filter(F.col("b").isNotNull())


def fit_ratio(docs: DataFrame, ids: DataFrame, n_ids: int, buckets: int = 65_536, smooth: float = 1.0) -> DataFrame:
    """One row (ratio array<double>): log p_target - log p_raw by bucket; the raw side counts all documents,
    the target side all with an id in ids."""

    def counted(rows: DataFrame, name: str) -> DataFrame:
        return gram_rows(rows, buckets).groupBy("b").agg(F.count(F.lit(1)).alias(name))

    counts = counted(words_of(docs), "r").join(counted(words_of(docs, ids, n_ids), "t"), "b", "left")
    every = docs.sparkSession.range(0, buckets, 1, 1).select(F.col("id").cast("int").alias("b"))
    counts = every.join(counts, "b", "left").na.fill(0, ["t", "r"]).withColumn("odd", F.col("b") % 2)
    totals = counts.groupBy("odd").agg(F.sum("t").alias("tt"), F.sum("r").alias("rr"))
    half = buckets / 2 * smooth
    ratio = F.log((F.col("t") + smooth) / (F.col("tt") + half)) - F.log((F.col("r") + smooth) / (F.col("rr") + half))
    rows = counts.join(F.broadcast(totals), "odd").select("b", F.when(F.col("tt") > 0, ratio).otherwise(F.lit(0.0)).alias("v"))
    packed = rows.agg(F.transform(F.sort_array(F.collect_list(F.struct("b", "v"))), lambda x: x["v"]).alias("ratio"))
    return checkpointed(packed)


def score(ratio: str, buckets: int, hashes: str = "_hashes", pairs: str = "_pairs") -> Column:
    """The mean log ratio over a document's n-grams; null without words."""

    def added(grams: str, start: Column, odd: int) -> Column:
        return F.aggregate(grams, start, lambda acc, h: acc + F.get(ratio, bucket(h, buckets, odd)))

    total = added(pairs, added(hashes, F.lit(0.0), 0), 1)
    return F.when(F.size(hashes) > 0, total / (2 * F.size(hashes) - 1))


def _judged(
    docs: DataFrame,
    trusted: DataFrame,
    columns: tuple[str, ...],
    buckets: int = 65_536,
    spread: float = 4.0,
    threshold: float | None = None,
) -> DataFrame:
    """A struct _doc of `columns` of docs, and OUTPUT."""
    halves = checkpointed(trusted_halves(trusted))
    n_ids = halves.count()
    model = fit_ratio(docs, halves.filter("_fit"), n_ids, buckets)
    view = f"plumbline_ratio_{uuid.uuid4().hex}"
    model.createOrReplaceTempView(view)
    ratio = F.expr(f"(SELECT ratio FROM {view})")

    def scored(df: DataFrame) -> DataFrame:
        return with_grams(df).withColumn("_ratio", ratio).withColumn("llr", score("_ratio", buckets))

    if threshold is None:
        good = scored(words_of(docs, halves.filter("not _fit"), n_ids))
        facts = good.agg(F.avg("llr").alias("m"), F.stddev_pop("llr").alias("d")).first()
        threshold = -1e9 if facts["m"] is None else round(facts["m"] - spread * facts["d"], 6)
    # what passes through is one struct, so that no name of docs meets a name used here
    out = docs.select(F.struct(*columns).alias("_doc"), "text", word_list(F.col("text")).alias("_words"))
    out = with_base_rules(scored(out))
    kept = ~F.col("base_failed") & F.coalesce(F.col("llr") >= F.lit(threshold), F.lit(False))
    # always true; it keeps the optimizer from moving a filter on kept below the array columns, which would
    # put their definitions inside each other's lambdas and compute them once per window
    kept = kept & (F.monotonically_increasing_id() >= 0)
    return out.select("_doc", *BASE, "llr", F.lit(threshold).alias("threshold"), kept.alias("kept"))


def judge(docs: DataFrame, trusted: DataFrame, columns: tuple[str, ...] = ("doc_id",), **settings) -> DataFrame:
    """`columns` of docs with the base columns, llr (mean log ratio), threshold and kept. trusted: (doc_id) of good
    documents. settings: those of the signature above."""
    return _judged(docs, trusted, columns, **settings).select(*[F.col("_doc")[c].alias(c) for c in columns], *OUTPUT)


def accepted(docs: DataFrame, trusted: DataFrame, **settings) -> DataFrame:
    """The rows of docs that are kept, with all their columns and no others."""
    rows = _judged(docs, trusted, tuple(docs.columns), **settings).filter("kept")
    return rows.select(*[F.col("_doc")[c].alias(c) for c in docs.columns])
