"""Mixing sources to target weights by weighted fair queueing.

Each source is a queue of its documents in a shuffled but reproducible order. A document's virtual
finish time is the words its source has sent up to and including it, divided by the source's weight.
A source may be sent `passes` times over, so a document has that many finish times. The mix is the
prefix of all copies by finish time whose words fit the total budget. A source that runs out leaves its
share to the others by weight, which is what the water level of `source_targets` states in closed form.

Order: that of a digest of id and text. Rows that share a digest are equal to each other and stand next to each other in
the queue, numbered from 1. Each has its own finish time, and the cut may fall between them.

Scale: texts are never shuffled, but by the source if there are more than BROADCAST_SOURCES of them. What is shuffled is
a slim table (source, size, shuffle key, count of equal rows), by (source, shuffle bucket): there are about as many
buckets as a bucket has rows, however large a source is, so no task meets a whole source, and equal rows are one row before
they are shuffled. Prefix sums go over bucket totals first. The global order is a range sort in about sqrt(copies) ranges
of finish time; ranges wholly below the budget are in, and only the range that holds the cut is ordered copy by copy. As
the order within a source is that of the shuffle key, the cut comes down to one key, and a number of equal rows, per
source and pass, and each document is decided where it is read. Only if the cut falls between equal rows, these rows are
written to the shared folder once, to be numbered there by task. The table of sources (one small row a source) is ranked
in one task.

Cases: a null text has size 0; a null source is the last queue; a null doc_id is a document as any other;
repeated rows are separate documents; documents of size 0 take part like others (taken is 0 whatever copies says); very
long texts are counted whole, and the mix may miss the budget by one of them; an empty table gives an empty table; input
columns that clash with an output name are dropped first.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import checkpointed, word_count, written

OUTPUT = ("size", "source_size", "target", "copies", "taken")
#: Up to so many sources the table of sources (under 100 bytes each) is broadcast; beyond, it is joined.
BROADCAST_SOURCES = 20_000


def source_targets(sizes: DataFrame, weights: Sequence[float], share: float, passes: int) -> DataFrame:
    """sizes: (source, source_size). Returns source, source_size, _weight and target: weights repeat over the
    sources in code-point order, null last; a target is at most passes * source_size, the excess is reshared
    by weight. The level is the largest (budget - caps before) / (weights from here) over sources in the order
    of cap / weight: it rises as long as a source is capped and falls afterwards."""
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    named = sizes.withColumn("_at", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1)
    named = named.withColumn("_weight", F.get(cycle, F.col("_at") % len(weights)))
    named = named.withColumn("_cap", F.col("source_size") * F.lit(float(passes)))
    by_fill = W.orderBy(F.col("_cap") / F.col("_weight"), "_at")
    before = by_fill.rowsBetween(W.unboundedPreceding, -1)
    everyone = W.orderBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    budget = F.sum("source_size").over(everyone) * F.lit(float(share))
    left = budget - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))
    owing = F.sum("_weight").over(by_fill.rowsBetween(0, W.unboundedFollowing))
    level = named.withColumn("_level", left / owing)
    level = level.withColumn("_level", F.max("_level").over(everyone))
    return level.withColumn("target", F.least(F.col("_cap"), F.col("_level") * F.col("_weight"))).select(
        "source", "source_size", "_at", "_weight", "target"
    )


def shuffle_key(seed: str) -> Column:
    """The place of a document in its source's queue: a digest of its id and text."""
    return F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.coalesce("text", F.lit(""))))


def _mixed(
    docs: DataFrame,
    weights: Sequence[float] = (3.0, 1.0, 2.0),
    share: float = 1.5,
    passes: int = 2,
    seed: str = "mix",
    size: Column | None = None,
    key: Column | None = None,
) -> DataFrame:
    """A struct _doc of all columns of docs, and OUTPUT."""
    size = word_count(F.col("text")) if size is None else size
    key = shuffle_key(seed) if key is None else key
    # what passes through is one struct, so that no name of docs meets a name used here
    rows = docs.select(F.struct(*docs.columns).alias("_doc"), "source", size.cast("long").alias("_size"), key.alias("_u"))
    slim = written(rows.groupBy("source", "_u", "_size").agg(F.count(F.lit(1)).alias("_d")))
    sizes = slim.groupBy("source").agg(F.sum(F.col("_size") * F.col("_d")).alias("source_size"), F.sum("_d").alias("_n"))
    sizes = checkpointed(sizes)
    table = source_targets(sizes.select("source", "source_size"), weights, share, passes)
    table = checkpointed(table.withColumnRenamed("source", "_s"))
    facts = sizes.agg(
        F.count(F.lit(1)).alias("sources"),
        F.coalesce(F.sum("_n"), F.lit(0)).alias("rows"),
        F.coalesce(F.sum("source_size"), F.lit(0)).alias("words"),
    ).first()
    last = table.agg(F.max(F.col("source_size") * float(passes) / F.col("_weight"))).first()[0] or 0.0
    budget = facts["words"] * float(share)
    few = F.broadcast if facts["sources"] <= BROADCAST_SOURCES else lambda df: df

    placed = _placed(slim, few(table), facts["rows"])
    cut = _cut(placed, passes, budget, last, facts["rows"])
    edge = [F.struct(F.lit(None).cast("string").alias("u"), F.lit(0).cast("long").alias("m"), F.lit(0).cast("long").alias("d")).alias(f"_k{p}") for p in range(passes)]
    if cut is None:
        keys = table.select("_at", *edge)
    else:
        inside = [_inside(p, cut) for p in range(passes)]
        keys = placed.groupBy("_at").agg(*[F.max(F.when(m > 0, F.struct(F.col("_u").alias("u"), m.alias("m"), F.col("_d").alias("d")))).alias(f"_k{p}") for p, m in enumerate(inside)])
    table = checkpointed(table.join(keys, "_at", "left"))
    split = [(F.col("_u") == F.col(f"_k{p}.u")) & (F.col(f"_k{p}.m") < F.col(f"_k{p}.d")) for p in range(passes)]
    parted = _any(split)
    out = rows.join(few(table), F.col("source").eqNullSafe(F.col("_s")), "left")
    whole = _counted(out, passes, None)
    if table.filter(_any([F.col(f"_k{p}.m") < F.col(f"_k{p}.d") for p in range(passes)])).limit(1).count():
        whole = _counted(out.filter(~parted), passes, None).unionByName(_counted(_numbered(out.filter(parted)), passes, F.col("_j")))
    return whole


def _any(conditions: Sequence[Column]) -> Column:
    found = F.lit(False)
    for c in conditions:
        found = found | F.coalesce(c, F.lit(False))
    return found


def _numbered(rows: DataFrame) -> DataFrame:
    """rows with _j, a number from 1 on among those of the same source and key: by task and place where they are written."""
    rows = written(rows.withColumn("_row", F.monotonically_increasing_id()).withColumn("_task", F.shiftright("_row", 33)))
    own = W.partitionBy("_at", "_u", "_task").orderBy("_row")
    before = W.partitionBy("_at", "_u").orderBy("_task").rowsBetween(W.unboundedPreceding, -1)
    tasks = rows.groupBy("_at", "_u", "_task").agg(F.count(F.lit(1)).alias("_n"))
    tasks = tasks.withColumn("_off", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    return rows.withColumn("_j", F.row_number().over(own)).join(tasks, ["_at", "_u", "_task"]).withColumn("_j", F.col("_j") + F.col("_off"))


def _counted(rows: DataFrame, passes: int, number: Column | None) -> DataFrame:
    """_doc and OUTPUT. A row is taken in a pass if its key is before that of the cut, or is that key and its number among
    equal rows is inside; without a number, all equal rows are."""
    copies = F.lit(0)
    for p in range(passes):
        here = F.col("_u") == F.col(f"_k{p}.u")
        here = here if number is None else here & (number <= F.col(f"_k{p}.m"))
        copies = copies + F.coalesce(((F.col("_u") < F.col(f"_k{p}.u")) | here).cast("int"), F.lit(0))
    return rows.select(
        "_doc",
        F.col("_size").alias("size"),
        "source_size",
        "target",
        copies.alias("copies"),
        (copies * F.col("_size")).cast("long").alias("taken"),
    )


def mix_sources(docs: DataFrame, **settings) -> DataFrame:
    """docs (doc_id, text, source, ...) with size, source_size, target, copies (times the mix takes the document) and taken
    (copies * size). settings: those of the signature above; `size` replaces the word count, `key` the shuffle key (rows of
    a source with the same key must have the same size)."""
    keep = [c for c in docs.columns if c.lower() not in OUTPUT]
    return _mixed(docs, **settings).select(*[F.col("_doc")[c].alias(c) for c in keep], *OUTPUT)


def mixed_rows(docs: DataFrame, **settings) -> DataFrame:
    """The mix itself: each document as often as it is taken, with all its columns and no others."""
    rows = _mixed(docs, **settings).filter(F.col("copies") > 0)
    rows = rows.select("_doc", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return rows.select(*[F.col("_doc")[c].alias(c) for c in docs.columns])


def _finish(p: int, number: Column) -> Column:
    """The virtual finish time, in pass p, of the number-th of a row's equal rows. _before is what its source has sent
    before the first of them."""
    return (F.col("_before") + number * F.col("_size") + F.col("source_size") * F.lit(p)) / F.col("_weight")


def _upto(p: int, time: Column, strictly: bool = False) -> Column:
    """How many of a row's equal rows have finished by `time` (before it, if strictly) in pass p. The number is computed by
    division and then set right by the finish times themselves, as those are what the order is made of."""
    done = lambda n: _finish(p, n) < time if strictly else _finish(p, n) <= time
    sent = time * F.col("_weight") - F.col("source_size") * F.lit(p) - F.col("_before")
    guess = F.greatest(F.lit(0.0), F.least(F.floor(sent / F.greatest("_size", F.lit(1))), F.col("_d").cast("double"))).cast("long")
    more, less = guess + 1, guess - 1
    n = F.when((more <= F.col("_d")) & done(more), more).when((guess > 0) & ~done(guess), less).otherwise(guess)
    return F.when(F.col("_size") > 0, n).otherwise(F.when(done(F.lit(1)), F.col("_d")).otherwise(F.lit(0)))


def _placed(slim: DataFrame, table: DataFrame, n_rows: int) -> DataFrame:
    """slim with _before, the words of its source before each row. About sqrt(n_rows) buckets of the key."""
    bits = min(30, math.ceil(math.log2(max(1, n_rows)) / 2))
    bucket = F.shiftright(F.conv(F.substring("_u", 1, 8), 16, 10).cast("long"), 32 - bits) if bits else F.lit(0).cast("long")
    words = F.col("_size") * F.col("_d")
    rows = slim.join(table, F.col("source").eqNullSafe(F.col("_s"))).withColumn("_b", bucket)
    sums = rows.groupBy("_at", "_b").agg(F.sum(words).alias("_in"))
    before = W.partitionBy("_at").orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    offsets = sums.select("_at", "_b", F.coalesce(F.sum("_in").over(before), F.lit(0)).alias("_off"))
    inside = W.partitionBy("_at", "_b").orderBy("_u").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("_cum", F.coalesce(F.sum(words).over(inside), F.lit(0))).join(offsets, ["_at", "_b"])
    return written(rows.select("_at", "_u", "_d", "_size", "_weight", "source_size", (F.col("_cum") + F.col("_off")).alias("_before")))


def _cut(placed: DataFrame, passes: int, budget: float, last: float, n_rows: int):
    """The place (finish time, source, shuffle key, number) of the last copy in the mix; None if it is empty."""
    if budget <= 0 or last <= 0:
        return None
    bins = max(16, math.isqrt(passes * n_rows))
    bin_of = lambda f: F.least(F.floor(f / F.lit(last) * bins), F.lit(bins - 1)).cast("long")
    sized = placed.filter("_size > 0")  # the others change no sum
    edges = lambda p: F.sequence(bin_of(_finish(p, F.lit(1))), bin_of(_finish(p, F.col("_d"))))
    # of each row and pass, the copies by bin: those up to the end of the bin less those up to its start. The copies of a bin
    # are found by their own finish times, so bins that a group of equal rows runs through cost a row each, not its copies
    spans = None
    for p in range(passes):
        span = sized.withColumn("bin", F.explode(edges(p)))
        first = F.when(F.col("bin") > bin_of(_finish(p, F.lit(1))), _upto_bin(p, F.col("bin") - 1, bin_of)).otherwise(F.lit(0)) + 1
        final = F.when(F.col("bin") < bin_of(_finish(p, F.col("_d"))), _upto_bin(p, F.col("bin"), bin_of)).otherwise(F.col("_d"))
        span = span.select("bin", "_size", "_before", "_weight", "source_size", F.lit(p).alias("p"), F.col("_at").alias("a"), F.col("_u").alias("u"), first.alias("j1"), final.alias("j2"))
        spans = span if spans is None else spans.union(span)
    per_bin = spans.groupBy("bin").agg(F.sum(F.col("_size") * (F.col("j2") - F.col("j1") + 1)).alias("words"))
    upto = per_bin.withColumn("upto", F.sum("words").over(W.orderBy("bin")))  # sqrt(copies) rows
    first = upto.filter(F.col("upto") > budget).orderBy("bin").first()
    if first is None:  # everything fits
        return {"f": float("inf")}
    own = spans.filter((F.col("bin") == first["bin"]) & (F.col("j2") >= F.col("j1"))).withColumn("j", F.explode(F.sequence("j1", "j2")))
    time = (F.col("_before") + F.col("j") * F.col("_size") + F.col("source_size") * F.col("p")) / F.col("_weight")
    own = own.select(time.alias("f"), "a", "u", "j", "_size")
    order = W.orderBy("f", "a", "u", "j").rowsBetween(W.unboundedPreceding, 0)  # the copies of one bin, about sqrt(copies)
    late = own.withColumn("upto", F.sum("_size").over(order)).filter(F.col("upto") > budget - (first["upto"] - first["words"]))
    return late.agg(F.min(F.struct("f", "a", "u", "j")).alias("k")).first()["k"]


def _upto_bin(p: int, at: Column, bin_of) -> Column:
    """How many of a row's equal rows finish in bin `at` or before it, in pass p: a binary search by finish times, as the
    bin of a finish time grows with the number."""
    low = F.lit(0).cast("long")
    step = F.aggregate(
        F.sequence(F.lit(0), F.ceil(F.log2(F.col("_d") + 1)).cast("int")),
        F.struct(low.alias("lo"), F.col("_d").alias("hi")),
        lambda acc, _: F.when(
            acc["lo"] < acc["hi"],
            F.when(
                bin_of(_finish(p, F.floor((acc["lo"] + acc["hi"] + 1) / 2).cast("long"))) <= at,
                F.struct(F.floor((acc["lo"] + acc["hi"] + 1) / 2).cast("long").alias("lo"), acc["hi"].alias("hi")),
            ).otherwise(F.struct(acc["lo"].alias("lo"), (F.floor((acc["lo"] + acc["hi"] + 1) / 2).cast("long") - 1).alias("hi"))),
        ).otherwise(acc),
        lambda acc: acc["lo"],
    )
    return step


def _inside(p: int, cut) -> Column:
    """How many of a row's equal rows come before the cut in pass p."""
    if math.isinf(cut["f"]):
        return F.col("_d")
    at = F.struct(F.col("_at").cast("long").alias("a"), F.col("_u").alias("u"))
    edge = F.struct(F.lit(cut["a"]).cast("long").alias("a"), F.lit(cut["u"]).alias("u"))
    time = F.lit(cut["f"])
    before, upto = _upto(p, time, strictly=True), _upto(p, time)
    return F.when(at < edge, upto).when(at > edge, before).otherwise(F.least(upto, F.greatest(before, F.lit(cut["j"] - 1))))
