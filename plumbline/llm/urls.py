"""URL filters: host and path rules, then logistic regression on hashed character n-grams.

Parsing and rules are built-in column functions. The model is a vector of `buckets` weights (128 KB) trained on the
driver from a small labelled URL table by full-batch gradient descent from zero, so the same table always gives
the same weights. A url's features are the n-grams (3 to 5 characters) of its host and, hashed apart, of its
path, each once; its logit is bias + (sum of weights) / sqrt(number of n-grams). Scoring is a narrow map over batches.

Cases: a null url, or one without ://, has empty host and path, no rule, and the verdict of the bias; repeated
rows are judged alike; of rules that fit and are equally long the one named last counts; very long urls are read whole; an
empty table gives an empty table; only the id and url columns are read, others may be there.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .pieces import STEP, char_values, code_points, mixed

ORDERS = (3, 4, 5)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: (verdict, host, path): a rule fits its host and all subdomains if the url's path starts with its path.
Rule = tuple[str, str, str]
DEFAULT_RULES: tuple[Rule, ...] = (
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
)

#: The labelled table: topic words in joined forms and hosts that are the same for both labels, so that only the
#: topic tells them apart. The words are general vocabulary, chosen without looking at the urls to be judged.
BLOCKED_TOPICS = (
    "casino poker roulette betting bets lottery jackpot pharmacy pills viagra steroids diet adult porn escort webcam"
    " loans payday replica counterfeit cracked warez torrents keygen spam phishing malware spyware ads adserver"
    " tracker tracking popups clickbait doorway"
).split()
ALLOWED_TOPICS = (
    "academy airport archive bakery bicycle biology bridge cathedral chemistry climate college council dentist drawing"
    " economy education energy farming fashion festival forest gallery garden geography grammar harbour health"
    " history hospital insects island journal kitchen language lecture library literature machine market medicine"
    " meteor mountain museum music nature nursery observatory opera orchard painting parliament philosophy physics"
    " planet poetry quarry railway recipes research river sailing school science sculpture society software stadium"
    " station story teacher theatre tourism tradition university village violin volcano weather wildlife winery"
    " writing yoga zoology"
).split()
JOINS = ("{}", "best-{}", "{}-online", "free{}")
#: Hosts and paths of the kind that the rules name.
SHAPES = ("http://{}.example.com/en/{}", "https://www.{}.example.org/fr/{}/", "https://blog.{}.example.net/de/{}.html", "http://m.{}.info/{}?page=2")


def labelled_urls() -> list[tuple[str, int]]:
    """(url, 1 to block or 0 to allow): every topic in every joined form and shape; paths are the same for both labels."""
    topics = [(t, 1) for t in BLOCKED_TOPICS] + [(t, 0) for t in ALLOWED_TOPICS]
    return [(shape.format(join.format(topic), 100 + 37 * k), label) for topic, label in topics for k, join in enumerate(JOINS) for shape in SHAPES]


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls."""
    rule = verdict = F.lit(None).cast("string")
    for what, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):  # the longest is asked first
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def _grams(column: pa.Array, buckets: int, salt: int) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of all character n-grams of a column of strings, and the row of each."""
    texts = column.to_pylist()
    data = code_points("".join(texts))
    row = np.repeat(np.arange(len(texts)), np.fromiter(map(len, texts), np.int64, len(texts)))
    values = char_values()[data]
    hashed, rows, total, factor = [], [], np.zeros(len(data), np.uint64), 1
    for n in range(1, max(ORDERS) + 1):
        if len(data) < n:
            break
        total = total[: len(data) - n + 1] + values[n - 1 :] * np.uint64(factor)
        factor = factor * STEP % 2**64
        if n in ORDERS:
            inside = row[: len(total)] == row[n - 1 :]
            hashed.append(mixed(total[inside] ^ np.uint64(salt + n)) % np.uint64(buckets))
            rows.append(row[: len(total)][inside])
    if not hashed:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(hashed).astype(np.int64), np.concatenate(rows)


def features(hosts: pa.Array, paths: pa.Array, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets and rows of all n-grams, each once a row, and 1 / sqrt(number of them) of each row."""
    a, i = _grams(hosts, buckets, 0x1000)
    b, j = _grams(paths, buckets, 0x2000)
    each = np.unique(np.concatenate([i, j]) * buckets + np.concatenate([a, b]))
    row, bucket = np.divmod(each, buckets)
    return bucket, row, 1 / np.sqrt(np.maximum(np.bincount(row, minlength=len(hosts)), 1))


def logits(hosts: pa.Array, paths: pa.Array, weights: np.ndarray) -> np.ndarray:
    bucket, row, scale = features(hosts, paths, len(weights) - 1)
    return weights[-1] + np.bincount(row, weights[bucket], len(hosts)) * scale


def train(
    table: Sequence[tuple[str, int]], buckets: int = 16_384, rounds: int = 2000, rate: float = 4.0, l2: float = 1e-5, prior: float = 0.1
) -> np.ndarray:
    """Weights by bucket, then the bias: the log odds of `prior`, the share of urls to block. It is fixed, as a small table
    says nothing of shares, so a url without known n-grams is allowed."""
    import re

    split = [re.search(r"://([^/?#]*)([^?#]*)", url) for url, _ in table]
    hosts = pa.array([m[1].translate(str.maketrans(UPPER, LOWER)) if m else "" for m in split])
    paths = pa.array([m[2] if m else "" for m in split])
    y = np.array([label for _, label in table], float)
    bucket, row, scale = features(hosts, paths, buckets)
    value, weights = scale[row], np.zeros(buckets + 1)
    weights[-1] = np.log(prior / (1 - prior))
    for _ in range(rounds):
        z = weights[-1] + np.bincount(row, weights[bucket] * value, len(y))
        error = (1 / (1 + np.exp(-z)) - y) / len(y)
        slope = np.bincount(bucket, error[row] * value, buckets)
        weights[:-1] -= rate * (slope + l2 * weights[:-1])
    return weights


@lru_cache(maxsize=4)
def _trained(table: tuple[tuple[str, int], ...]) -> np.ndarray:
    return train(table)


def judge(
    pages: DataFrame, rules: Sequence[Rule] = DEFAULT_RULES, table: Sequence[tuple[str, int]] | None = None, threshold: float = 0.5, id_column: str = "page_id"
) -> DataFrame:
    """page_id, host, path, rule, verdict, probability (of block, by the model)."""
    weights = _trained(tuple(map(tuple, labelled_urls() if table is None else table)))
    parsed = pages.select(id_column, host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    parsed = parsed.withColumns({"rule": rule, "by_rule": verdict})
    kind = parsed.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            block = 1 / (1 + np.exp(-logits(batch.column(1), batch.column(2), weights)))
            own = pa.array(np.where(block >= threshold, "block", "allow"), pa.string())
            by_rule = batch.column(4)
            final = pc.if_else(pc.is_valid(by_rule), by_rule, own)
            yield pa.record_batch([*batch.columns[:4], final, pa.array(block)], names=[id_column, "host", "path", "rule", "verdict", "probability"])

    return parsed.mapInArrow(run, f"`{id_column}` {kind}, host string, path string, rule string, verdict string, probability double")
