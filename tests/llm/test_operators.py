"""Each operator against a brute-force version, on texts with nulls, ties, repeats and odd characters."""

import base64
import hashlib
import os
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from plumbline.llm import ann, bpe, chat, langid, mixing, pieces, quality, simhash, substr, token_io, urls

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(seed, n):
    r = random.Random(seed)
    return " ".join("".join(r.choices(["th", "er", "on", "an", "re", "sh", "é", "ñ"], k=r.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    shared = prose(1, 60)
    out = [(i, prose(100 + i, 30 + 7 * i), ["en", "fr", None][i % 3], f"s{i % 4}") for i in range(12)]
    out += [
        (20, None, "en", "s1"),
        (21, "", "fr", None),
        (22, " \t\n\x0b\x0c\r ", None, "s2"),
        (23, "one", "en", "s0"),
        (24, "one two", "en", "s0"),
        (25, out[3][1], "en", "s3"),  # an exact copy
        (26, out[3][1] + " more", "en", "s3"),  # a near copy
        (27, f"{prose(5, 20)} {shared} {prose(6, 9)}", "en", "s1"),
        (28, f"{prose(7, 33)}\n{shared}\u00a0x {prose(8, 4)}", "fr", "s1"),
        (29, "a b c d e f g h " * 6 + "$$ ## <x>\nline\nline\n\nline", None, "s2"),
        (30, "don't we'll 'tis I've  \n\n  12 half ½ 漢字 <|endoftext|>\u2003\u2003x 😀😀", "en", "s2"),
        (31, prose(9, 6_000), "en", "s0"),  # long
        (31, "the same id again " + prose(10, 20), "en", "s0"),
        (None, prose(11, 40), "fr", "s3"),
        (None, None, None, None),
        (32, shared, "en", "s1"),
        (32, shared, "en", "s1"),  # a repeated row
    ]
    return [(*r, len(r[1]) if r[1] is not None else None) for r in out]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(3)


def clashing(df):
    """df with extra columns named like helpers and outputs."""
    return df.withColumns({c: F.lit("x") for c in ("size", "kept", "fp", "n_words", "copies", "target", "llr", "rule", "verdict", "score", "rank", "key", "places", "_key", "_stay", "_size", "_u", "_s", "_at", "_doc", "_words", "_hashes", "_ratio", "_t", "_k0")})


def words(text):
    return WORD.findall(text or "")


def spread(found, key):
    out = {}
    for r in found:
        out.setdefault(r[key], []).append(r)
    return out


# -- 1, 9: tokens -------------------------------------------------------------------------------------------------


def test_pieces_match_the_pattern():
    import regex

    pattern, r = regex.compile(P.PATTERN), random.Random(3)
    alphabet = [*"ab'strevmdl \n\t\u3000é1½!?-漢😀\x1c\x85\u00a0", "'s", "'re", " 'll", "  ", "'''"]
    texts = ["".join(r.choices(alphabet, k=r.randint(0, 30))) for _ in range(3000)]
    joined = "".join(texts)
    sizes = np.array([len(t) for t in texts])
    first = np.zeros(len(joined), bool)
    first[(np.cumsum(sizes) - sizes)[sizes > 0]] = True
    starts = np.flatnonzero(pieces.piece_starts(pieces.code_points(joined), first))
    found = [joined[a:b] for a, b in zip(starts, [*starts[1:], len(joined)], strict=True)]
    assert found == [p for t in texts for p in pattern.findall(t)]


def test_merge_replay_equals_tiktoken(spark, docs, rows):
    import tiktoken

    path = P.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    found = bpe.digest_documents(clashing(docs), path, with_ids=True).collect()
    got = sorted((r["doc_id"] or -1, r["ids"], r["n_tokens"], r["decoded_sha256"]) for r in found)
    want = [(i or -1, enc.encode_ordinary(t or ""), hashlib.sha256((t or "").encode()).hexdigest()) for i, t, *_ in rows]
    assert got == sorted((i, ids, len(ids), sha) for i, ids, sha in want)
    sha = {hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest() for _, ids, _ in want}
    assert {r["ids_sha256"] for r in found} == sha
    assert bpe.encode_documents(docs.limit(0), path).count() == 0


def test_merge_replay_with_overlaps_and_ranks_out_of_order():
    import tiktoken

    ranks = {bytes([b]): b for b in range(256)}
    for i, t in enumerate([b"bc", b"abc", b"aa", b"aaaa", b"ab", b"aaa", b"abab", b"ba"]):
        ranks[t] = 256 + [5, 0, 3, 1, 4, 2, 6, 7][i]
    enc = tiktoken.Encoding("x", pat_str=r".+", mergeable_ranks=ranks, special_tokens={})
    r, replay = random.Random(0), bpe.MergeReplay(ranks)
    texts = ["".join(r.choices("abc", k=r.randint(1, 12))) for _ in range(2000)]
    ids, sizes = replay.encode(texts)
    at = np.cumsum(sizes) - sizes
    assert [ids[a : a + n].tolist() for a, n in zip(at, sizes, strict=True)] == [enc.encode_ordinary(t) for t in texts]


def test_token_files_read_back(spark, docs, rows, tmp_path):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    token_io.write_tokens(clashing(docs), P.path("byte_bpe_50k.json"), str(tmp_path / "a"))
    found = sorted(token_io.document_digests(spark, str(tmp_path / "a")).collect(), key=lambda r: r["start"])
    ids = {}
    for i, t, *_ in rows:
        own = [*tok.encode(t or "", add_special_tokens=False).ids, 0]
        ids.setdefault(i, []).append((len(own), zlib.crc32(np.array(own, "<u4").tobytes())))
    order = [r["doc_id"] for r in found]
    assert order == sorted(order, key=lambda x: (x is not None, x or 0))
    at = 0
    for r in found:
        assert r["start"] == at
        at += r["n_tokens"]
        ids[r["doc_id"]].remove((r["n_tokens"], r["ids_crc32"]))
    assert not any(ids.values())
    assert 50256 in tok.encode(rows[22][1], add_special_tokens=False).ids  # the library's default finds added tokens
    token_io.write_tokens(docs.limit(0), P.path("byte_bpe_50k.json"), str(tmp_path / "b"))
    assert token_io.document_digests(spark, str(tmp_path / "b")).count() == 0


def test_special_strings_and_repeated_ids(spark, tmp_path):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|>y", "<|endoftext|", "plain words", "", None] * 30
    df = spark.createDataFrame([(7 if i % 2 else None, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(4)
    token_io.write_tokens(df, P.path("byte_bpe_50k.json"), str(tmp_path / "t"))
    found = sorted(token_io.document_digests(spark, str(tmp_path / "t")).collect(), key=lambda r: r["start"])
    want = sorted((zlib.crc32(np.array([*tok.encode(t or "", add_special_tokens=False).ids, 0], "<u4").tobytes()), i % 2) for i, t in enumerate(texts))
    assert sorted((r["ids_crc32"], int(r["doc_id"] is not None)) for r in found) == want
    assert [r["doc_id"] for r in found] == [None] * 105 + [7] * 105
    assert all(a["start"] + a["n_tokens"] == b["start"] for a, b in zip(found, found[1:], strict=False))


def test_many_empty_documents_fill_a_block_in_time(spark):
    import time

    rows = spark.range(0, 300_000, 1, 1).select(F.lit(0).alias("part"), F.col("id").alias("start"), F.col("id").alias("doc_id"), F.lit(1).cast("long").alias("n"), F.unhex(F.lit("0000")).alias("ids"))
    began = time.time()
    blocks = token_io.to_blocks(rows, np.array([0]), 2).agg(F.sum("n_docs").alias("docs"), F.count(F.lit(1)).alias("blocks")).first()
    assert blocks["docs"] == 300_000 and blocks["blocks"] == 1 and time.time() - began < 30


@pytest.mark.parametrize("wide", [False, True])
def test_blocks_round_trip(wide):
    r = np.random.default_rng(0)
    ranks = r.integers(0, 2**31 if wide else 65_536, 1001).astype(np.uint32)
    ranks[:500] %= 200
    block = token_io.encode_block([5, None, -7], np.array([1, 0, 1000]), ranks, wide)
    ids, sizes, back = token_io.decode_block(block)
    assert ids == [5, None, -7] and sizes.tolist() == [1, 0, 1000] and (back == ranks).all()
    assert token_io.decode_block(token_io.encode_block([], np.zeros(0, int), ranks[:0], wide))[2].size == 0


# -- 2: quality -----------------------------------------------------------------------------------------------------


def base_rules(text):
    w = words(text)
    seen, n_dup = set(), 0
    for line in (text or "").split("\n"):
        if words(line):
            n_dup += line in seen
            seen.add(line)
    wins = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    cover = {i + k for i, x in enumerate(wins) if wins.count(x) > 1 for k in range(8)} if len(wins) < 3000 else set()
    n = len(w)
    return n, sum(map(len, w)), sum(c in "#*$%&|<>" for c in "".join(w)), n_dup, len(cover), n < 20 or 100 * len(cover) > 30 * n


def xx(*parts):
    """Spark's xxhash64 of strings or longs."""
    import xxhash

    h = 42
    for p in parts:
        h = xxhash.xxh64_intdigest(p.encode() if isinstance(p, str) else int(p).to_bytes(8, "little", signed=True), h)
    return h - 2**64 if h >= 2**63 else h


def test_quality_rules(spark, docs, rows):
    trusted = spark.createDataFrame([(i,) for i in (0, 1, 2, 4, 5, None, 5, 99)], "doc_id long")
    buckets = 512
    found = quality.judge(clashing(docs), trusted, buckets=buckets, threshold=-0.02).collect()
    by = spread(found, "doc_id")
    sample = {r["_t"]: r["_fit"] for r in quality.trusted_halves(trusted).collect()}
    assert set(sample) == {0, 1, 2, 4, 5, 99}
    counts = np.ones((2, buckets))
    grams = {}
    for k, (i, text, *_) in enumerate(rows):
        h = [xx(w) for w in words(text)]
        # two longs are hashed as Spark hashes columns: each with the hash before as its seed
        g = [2 * (x % (buckets // 2)) for x in h] + [2 * (pair(a, b) % (buckets // 2)) + 1 for a, b in zip(h, h[1:], strict=False)]
        grams[k] = g
        for b in g:
            counts[1, b] += 1
            counts[0, b] += bool(sample.get(i))
    total = np.stack([counts[:, 0::2].sum(1), counts[:, 1::2].sum(1)])
    ratio = np.log(counts[0] / total[np.arange(buckets) % 2, 0]) - np.log(counts[1] / total[np.arange(buckets) % 2, 1])
    for k, (i, text, *_) in enumerate(rows):
        want = base_rules(text)
        llr = np.mean([ratio[b] for b in grams[k]]) if grams[k] else None
        match = [r for r in by[i] if tuple(r[c] for c in quality.BASE) == want and ((r["llr"] is None) == (llr is None)) and (llr is None or abs(r["llr"] - llr) < 1e-9)]
        assert match, (i, want, llr, by[i])
        assert match[0]["kept"] == (not want[-1] and llr is not None and llr >= -0.02)
    assert len(found) == len(rows)


def pair(a, b):
    """Spark's xxhash64 of two longs: the hash of the first seeds the second."""
    import xxhash

    h = xxhash.xxh64_intdigest(int(a).to_bytes(8, "little", signed=True), 42)
    h = xxhash.xxh64_intdigest(int(b).to_bytes(8, "little", signed=True), h)
    return h - 2**64 if h >= 2**63 else h


def test_quality_joins_when_there_are_too_many_ids_to_broadcast(spark, docs, monkeypatch):
    trusted = spark.createDataFrame([(i,) for i in (0, 1, 2, 4, 5, 9, None)], "doc_id long")
    key = lambda r: tuple(str(x) for x in r)
    one = sorted(map(key, quality.judge(docs, trusted, buckets=256).collect()))
    monkeypatch.setattr(quality, "BROADCAST_IDS", 0)
    assert one == sorted(map(key, quality.judge(docs, trusted, buckets=256).collect()))


@pytest.mark.parametrize("width", [2, 3, 7, 8, 11])
def test_quality_windows_put_together_from_halves(spark, width):
    """Windows of any width, at and around the lengths where there is none, one or a repeated one."""
    r = random.Random(width)
    texts = [" ".join(r.choices("ab", k=n)) for n in [*range(2 * width + 2), 60]] + ["a b " * 20, " ".join(map(str, range(40)))]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string").select("i", F.array_remove(F.split("text", " "), "").alias("_words"))
    for i, n in quality.with_repeat_words(quality.with_grams(docs), width=width).select("i", "n_repeat_words").collect():
        w = words(texts[i])
        wins = [tuple(w[k : k + width]) for k in range(len(w) - width + 1)]
        assert n == len({k + j for k, x in enumerate(wins) if wins.count(x) > 1 for j in range(width)}), (texts[i], width)


def test_quality_does_no_lookup_by_place_for_each_gram_or_window(spark, docs, monkeypatch):
    """slices of 8 for each window and lookups for each pair took most of op2's time; and counting is compiled, so no
    function over array elements is left in it."""
    counted, keep = [], quality.checkpointed
    monkeypatch.setattr(quality, "checkpointed", lambda df: counted.append(df) or keep(df))
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    judged = quality.judge(docs, docs.select("doc_id").limit(3), buckets=256)
    generated = [x for df in counted for x in plan(df).splitlines() if "Generate " in x or "Relation" in x or "_words" in x]
    assert any("explode" in x for x in generated) and not any("lambdafunction" in x for x in generated)
    assert "sequence(" not in plan(judged) and "zip_with(" in plan(judged)


def test_quality_on_empty_tables_and_filters(spark, docs):
    none = spark.createDataFrame([], "doc_id long")
    assert quality.judge(docs.limit(0), none).count() == 0
    odd = clashing(docs).drop(*quality.OUTPUT)
    judged = quality.judge(odd, none, columns=tuple(odd.columns))
    assert {r["llr"] for r in judged.collect()} <= {0.0, None}
    assert judged.filter("kept").count() == sum(r["kept"] for r in judged.collect())
    stay = quality.accepted(clashing(docs), none)
    assert stay.columns == clashing(docs).columns and stay.count() == judged.filter("kept").count()


# -- 3: language ----------------------------------------------------------------------------------------------------


def test_language_id(spark, docs):
    r = random.Random(2)
    texts = {"de": ["und", "der", "sch", "ung", "ein"], "es": ["ción", "que", "los", "ñez", "mente"]}
    train = [(i, " ".join("".join(r.choices(texts[k], k=3)) for _ in range(40)), k) for i in range(200) for k in texts]
    df = spark.createDataFrame(train, "doc_id long, text string, lang string").repartition(3)
    model = langid.fit(df.filter(~langid.held_out(F.col("doc_id"))), rows_per_language=60)
    found = langid.predict(clashing(df), model).join(df.select("doc_id", "lang").distinct(), "doc_id")
    held = found.filter("held_out").collect()
    assert {r["doc_id"] for r in held} == {i for i, *_ in train if zlib.crc32(str(i).encode()) % 3 == 1}
    predicted = {(r["doc_id"], r["lang_pred"]) for r in held}
    assert len(predicted) == 2 * len({r["doc_id"] for r in held})  # one text of each language under each id
    odd = spark.createDataFrame([(1, None, None), (2, "12 !?", "de"), (None, "UND DER", None)], "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in langid.predict(odd, model).collect()}
    assert got[1]["lang_pred"] == got[2]["lang_pred"] == "und" and got[2]["score"] == 0
    assert got[None]["lang_pred"] == "de" and 0 <= got[None]["score"] <= 1
    nothing = langid.fit(odd.filter("doc_id = 1"))
    assert {r["lang_pred"] for r in langid.predict(docs, nothing).collect()} == {"und"}
    assert langid.predict(docs.limit(0), model).count() == 0


def test_naive_bayes_equals_brute_force(spark):
    import math
    import unicodedata

    texts = [("Straße über Öl", "de"), ("le été, ça va", "fr"), ("ab ab 12 ab", "de"), ("x-y", "fr"), ("żółw İx", "pl")] * 4
    df = spark.createDataFrame([(i, t, k) for i, (t, k) in enumerate(texts)], "doc_id long, text string, lang string").repartition(3)
    model = langid.fit(df, buckets=1 << 15, rows_per_language=10**6)

    def grams(text):
        low = "".join((c.lower() if len(c.lower()) == 1 else c) if unicodedata.category(c)[0] == "L" else " " for c in text)
        low = " " + " ".join(low.split()) + " "
        return [low[i : i + n] for n in (1, 2, 3) for i in range(len(low) - n + 1)]

    counts = {}
    for t, k in texts:
        for g in grams(t):
            counts.setdefault(k, {}).setdefault(g, 0)
            counts[k][g] += 1
    assert len({g for c in counts.values() for g in c}) < 200  # so few that buckets are not shared, which the equality needs
    asked = ["über", "ab été", "żó xy q", "Öl"]
    for text, name, score in zip(asked, *model.predict(asked), strict=True):
        logs = {}
        for k, c in counts.items():
            total = sum(c.values()) + 0.5 * (1 << 15)
            logs[k] = math.log(sum(1 for _, x in texts if x == k) / len(texts)) + sum(math.log((c.get(g, 0) + 0.5) / total) for g in grams(text))
        best = max(sorted(logs), key=lambda k: logs[k])
        assert name == best
        assert abs(score - 1 / sum(math.exp(x - logs[best]) for x in logs.values())) < 1e-4


def test_many_languages_shrink_the_matrix(spark, monkeypatch):
    monkeypatch.setattr(langid, "MAX_CELLS", 1 << 13)
    df = spark.createDataFrame([(i, f"text {'abcde'[i % 5] * 9}", f"l{i % 5}") for i in range(50)], "doc_id long, text string, lang string")
    model = langid.fit(df)
    assert model.matrix.size <= 1 << 13 and model.predict(["ccccccccc"])[0] == ["l2"]
    monkeypatch.setattr(langid, "MAX_CELLS", 1 << 11)
    with pytest.raises(ValueError, match="languages"):
        langid.fit(df)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test tables")
def test_held_out_accuracy_on_the_tables(spark):
    from plumbline.llm import queries

    found = queries.op3_language_id(spark, "/root/testdata/sf0.01").filter("held_out and lang_pred <> 'und'")
    known = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").filter("lang is not null").select("doc_id", "lang")
    hits = found.join(known, "doc_id").select(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")).alias("a"), F.count(F.lit(1)).alias("n")).first()
    assert hits["n"] > 100 and hits["a"] > 0.97


# -- 4: neighbours --------------------------------------------------------------------------------------------------


def test_neighbours_equal_brute_force(spark):
    r = np.random.default_rng(1)
    x = r.standard_normal((700, 24)).astype(np.float32)
    x[100:300] = x[7]  # one vector a third of the rows
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(800, None), (850, [0.0] * 24), (900, [float("nan")] * 24), (950, [1.0] * 3), (1000, [None] * 24), (None, [1.0] * 24)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(5)
    found = ann.search(clashing(df), F.coalesce(F.col("vec_id") % 50 == 0, F.lit(False)), data_block=100).collect()
    by = spread(found, "query_id")
    assert set(by) == set(range(0, 700, 50))
    hits = 0
    for q, got in by.items():
        score = ann.cosines(x.astype(float), x[q].astype(float))
        want = sorted((i for i in range(700) if i != q), key=lambda i: (-score[i], i))[:5]
        got = sorted(got, key=lambda y: y["rank"])
        assert [y["rank"] for y in got] == [1, 2, 3, 4, 5]
        hits += len({y["vec_id"] for y in got} & set(want))
        assert all(y["score"] == score[y["vec_id"]] for y in got)
        if q in (100, 150):
            assert [y["vec_id"] for y in got] == want
    assert hits >= 0.95 * 5 * len(by)
    huge = spark.createDataFrame([(i, (v * (1e200 if i % 2 else 1e-200)).tolist()) for i, v in enumerate(x[:90].astype(float))], "vec_id long, embedding array<double>")
    score = ann.cosines(x[:90].astype(float), x[0].astype(float))
    got = [(y["vec_id"], y["score"]) for y in ann.search(huge, F.col("vec_id") == 0).orderBy("rank").collect()]
    want = sorted(range(1, 90), key=lambda i: (-score[i], i))[:5]
    assert [i for i, _ in got] == want and all(abs(s - score[i]) < 1e-12 for i, s in got)
    few = df.filter("vec_id in (0, 1, 2)")
    assert ann.search(few, F.col("vec_id") == 0).count() == 2
    assert ann.search(df.limit(0), F.lit(True)).count() == 0


def test_neighbours_of_repeated_ids_and_two_dimensions(spark):
    """Every row counts: rows that share an id are candidates of each other, and each dimension is searched."""
    r = np.random.default_rng(3)
    rows = [(int(r.integers(0, 120)), r.integers(-2, 3, 8 if i % 3 else 5).astype(float).tolist()) for i in range(400)]
    rows = [(d, v) for d, v in rows if any(v)] + [(0, [1.0] * 8), (0, [1.0] * 8), (50, [1.0, 2.0]), (51, [2.0, 1.0]), (100, [3.0, 1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    found = ann.search(df, F.col("vec_id") % 50 == 0, epsilon=50.0, data_block=90).collect()
    got = Counter((x["query_id"], x["rank"], x["vec_id"], x["score"]) for x in found)
    want = Counter()
    for q, (query, x) in enumerate(rows):
        if query % 50 == 0:
            other = [(-ann.cosines(np.array([y]), np.array(x))[0], d) for i, (d, y) in enumerate(rows) if i != q and len(y) == len(x)]
            want.update((query, i + 1, d, -score) for i, (score, d) in enumerate(sorted(other)[:5]))
    assert got == want and {x[0] for x in want} == {0, 50, 100}


# -- 5: urls --------------------------------------------------------------------------------------------------------


def test_url_filter(spark):
    cases = [
        ("http://a.net/x", "a.net", "/x", "net/"),
        ("http://a.net", "a.net", "", None),
        ("https://M.Example.NET/en/1?q#f", "m.example.net", "/en/1", "example.net/en/"),
        ("x://example.com/de/9#a?b", "example.com", "/de/9", "example.com/de/"),
        ("http://badexample.com/de/9", "badexample.com", "/de/9", None),
        ("http://z.org/fr/2", "z.org", "/fr/2", "org/fr/"),
        ("nothing", "", "", None),
        ("http://h?x://y", "h", "", None),
        ("http://cheap-pills.example.com/en/1", "cheap-pills.example.com", "/en/1", None),
        (None, "", "", None),
        ("http://library.example.com/" + "a" * 50_000, "library.example.com", "/" + "a" * 50_000, None),
    ]
    df = spark.createDataFrame([(i, c[0], "<html>") for i, c in enumerate(cases)] + [(None, "http://a.net/x", None)], "page_id long, url string, html string")
    got = {r["page_id"]: r for r in urls.judge(clashing(df)).collect()}
    for i, (_, host, path, rule) in enumerate(cases):
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == (host, path, rule)
    assert [got[i]["verdict"] for i in (0, 2, 3, 5, 8, 10)] == ["block", "allow", "block", "allow", "block", "allow"]
    assert got[6]["verdict"] == got[9]["verdict"] == "allow" and got[None]["verdict"] == "block"
    assert urls.judge(df.limit(0)).count() == 0
    weights = urls.train(urls.labelled_urls())
    assert (weights == urls.train(urls.labelled_urls())).all()


def test_url_logits_equal_brute_force():
    buckets, r = 4096, np.random.default_rng(0)
    weights = r.standard_normal(buckets + 1)
    hosts, paths = ["a.bücher.example", "", "x", "abcabcabc.org"], ["/é/漢字漢字漢", "", "/", "/a?b"[:2]]
    mask = 2**64 - 1

    def mix(x):
        x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & mask
        x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & mask
        return x ^ (x >> 31)

    def hashed(gram, salt):
        value = sum(mix((ord(c) + 1) * 0xD1342543DE82EF95 & mask) * pow(pieces.STEP, k, 2**64) for k, c in enumerate(gram)) & mask
        return mix(value ^ (salt + len(gram))) % buckets

    got = urls.logits(pa.array(hosts), pa.array(paths), weights)
    for k, (h, p) in enumerate(zip(hosts, paths, strict=True)):
        own = {hashed(t[i : i + n], salt) for t, salt in ((h, 0x1000), (p, 0x2000)) for n in (3, 4, 5) for i in range(len(t) - n + 1)}
        assert abs(got[k] - (weights[-1] + sum(weights[b] for b in own) / max(1, len(own)) ** 0.5)) < 1e-9


def test_url_model_on_forms_it_has_not_seen():
    weights = urls.train(urls.labelled_urls())
    for topics, least, most in ((urls.BLOCKED_TOPICS, 0.7, 1.0), (urls.ALLOWED_TOPICS, 0.0, 0.02)):
        hosts = [form.format(t) for t in topics for form in ("get-{}.example", "{}-zone.example")]
        assert not set(hosts) & {u.split("/")[2] for u, _ in urls.labelled_urls()}
        block = urls.logits(pa.array(hosts), pa.array(["/5"] * len(hosts)), weights) >= 0
        assert least <= block.mean() <= most


# -- 6: near-duplicates ---------------------------------------------------------------------------------------------


def slow_fingerprint(text):
    import xxhash

    w = [x.translate(str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})) for x in words(text)]
    if not w:
        return 0
    sh = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_components(fps):
    label = list(range(len(fps)))
    for _ in fps:
        for i in range(len(fps)):
            near = [label[j] for j in range(len(fps)) if (fps[i] ^ fps[j]).bit_count() <= 2]
            label[i] = min(near)
    return label


def test_simhash_classes(spark, docs, rows):
    found = simhash.classes(clashing(docs)).collect()
    fps = [slow_fingerprint(t) for _, t, *_ in rows]
    label = slow_components(fps)
    assert simhash.fingerprint(rows[-6][1], piece=97) == fps[-6]
    want = []
    for k, (i, *_) in enumerate(rows):
        own = [rows[j][0] for j in range(len(rows)) if label[j] == label[k] and rows[j][0] is not None]
        want.append((i, f"{fps[k]:016x}", min(own, default=None)))
    key = lambda r: tuple((x is not None, x or 0) for x in (r[0], int(r[1], 16), r[2]))
    assert sorted((tuple(r) for r in found), key=key) == sorted(want, key=key)
    assert simhash.classes(docs.limit(0)).count() == 0
    stay = simhash.keep_one(clashing(docs))
    assert stay.columns == clashing(docs).columns
    kept = [(r["doc_id"], r["text"]) for r in stay.collect()]
    groups = {}
    for k, (i, t, *_) in enumerate(rows):
        groups.setdefault(label[k], []).append((i is None, i or 0, t))
    assert len(kept) == len(groups)  # one row of each component, though ids repeat or are null
    for own in groups.values():
        least = min(own)[:2]
        assert sum((None if x[0] else x[1], x[2]) in kept for x in {(a, b, t) for a, b, t in own if (a, b) == least}) == 1


def test_near_copies_without_an_id_go(spark):
    text, other = prose(40, 60), prose(41, 60)
    df = spark.createDataFrame([(5, text), (None, text), (None, other), (9, text), (9, other)], "doc_id long, text string").repartition(2)
    assert sorted((r["doc_id"], r["text"] == text) for r in simhash.keep_one(df).collect()) == [(5, True), (9, False)]


@pytest.mark.parametrize(("bits", "crowd", "segments"), [(2, 64, 7), (2, 3, 7), (2, 64, 5), (2, 1, 3), (1, 2, 7), (1, 64, 4), (3, 4, 10), (3, 1, 5), (0, 1, 4), (4, 64, 13), (4, 4, 13)])
def test_simhash_links_lose_nothing(spark, bits, crowd, segments):
    r = random.Random(crowd)
    fps = {r.getrandbits(64) for _ in range(40)}
    for base in list(fps)[:8]:
        for _ in range(30):
            x = base
            for b in r.sample(range(64), r.randint(0, 4)):
                x ^= 1 << b
            fps.add(x)
    signed = [x - 2**64 if x >= 2**63 else x for x in fps]
    edges = simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long"), bits, segments, crowd)
    got = sorted((x["a"], x["b"]) for x in edges.collect())
    order = sorted(signed)
    want = [(a, b) for k, a in enumerate(order) for b in order[k + 1 :] if ((a ^ b) & (2**64 - 1)).bit_count() <= bits]
    assert got == want


def test_crowded_keys_make_few_candidates(spark):
    """3,000 fingerprints with the same first segments are 4.5 million pairs; the longer chain lets hardly any through but links."""
    r = random.Random(0)
    fps = sorted({r.getrandbits(30) for _ in range(3000)})
    table = spark.createDataFrame([(x,) for x in fps], "fp long")
    n_links = simhash.links(table).count()
    assert simhash.candidates(table).count() <= 40 * n_links + 3000


# -- 7: mixing ------------------------------------------------------------------------------------------------------


def test_mixing(spark, docs, rows):
    got = mixing.mix_sources(clashing(docs)).collect()
    again = mixing.mix_sources(docs.repartition(5)).collect()
    key = lambda r: (r["doc_id"] or -1, r["size"], r["taken"])
    assert sorted(map(key, got)) == sorted(map(key, again)) and len(got) == len(rows)
    size = {}
    for _, t, _, s, _ in rows:
        size[s] = size.get(s, 0) + len(words(t))
    target = {s: 0.0 for s in size}
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(sorted(size, key=lambda x: (x is None, x)))}
    left, open_ = 1.5 * sum(size.values()), set(size)
    while open_ and left > 1e-9:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if target[s] + level * weight[s] >= 2 * size[s]}
        for s in full or open_:
            add = 2 * size[s] - target[s] if full else level * weight[s]
            target[s] += add
            left -= add
        open_ -= full
        if not full:
            break
    largest = max(len(words(t)) for _, t, *_ in rows)
    for r in got:
        assert r["source_size"] == size[r["source"]] and abs(r["target"] - target[r["source"]]) < 1e-6
        assert r["taken"] == r["copies"] * r["size"] and 0 <= r["copies"] <= 2
    taken = sum(r["taken"] for r in got)
    assert 1.5 * sum(size.values()) - largest <= taken <= 1.5 * sum(size.values()) + 2 * largest
    for s in size:
        assert abs(sum(r["taken"] for r in got if r["source"] == s) - target[s]) <= 2 * largest
    assert mixing.mix_sources(docs.limit(0)).count() == 0
    mixed = mixing.mixed_rows(clashing(docs))
    assert mixed.columns == clashing(docs).columns and mixed.count() == sum(r["copies"] for r in mixing.mix_sources(docs).collect())


def slow_mix(rows, weight, passes=2, share=1.5):
    """Taken copies as a multiset of (doc_id, source, copies): every copy in the order of finish times, until one does not fit."""
    size = {}
    for i, t, s in rows:
        size[s] = size.get(s, 0) + len(words(t))
    queue, copies = {}, []
    for i, t, s in rows:
        u = hashlib.md5(f"mix|{'-' if i is None else i}|{t or ''}".encode()).hexdigest()
        queue.setdefault(s, []).append((u, i, len(words(t))))
    for at, s in enumerate(sorted(queue, key=lambda x: (x is None, x or ""))):
        sent, number = 0, {}
        for u, i, n in sorted(queue[s], key=lambda x: x[0]):
            sent, number[u] = sent + n, number.get(u, 0) + 1
            copies += [((sent + size[s] * p) / weight[at % len(weight)], at, u, number[u], n, i, s) for p in range(passes)]
    room, taken = share * sum(size.values()), {}
    for _, _, u, j, n, i, s in sorted(copies):
        if n > room:
            break
        room -= n
        taken[i, s, u, j] = taken.get((i, s, u, j), 0) + 1
    return sorted(((i, s, taken.get((i, s, u, j), 0)) for _, _, u, j, _, i, s in sorted(copies)[::1]), key=str)


@pytest.mark.parametrize("seed", range(4))
def test_mixing_with_repeated_rows_equals_brute_force(spark, seed):
    r = random.Random(seed)
    rows = [(i, "w " * r.randint(0, 12), r.choice(["a", "c", None])) for i in range(60)]
    rows += [(1000, "same row here", "b")] * r.choice([1, 70, 200]) + [(None, "no id", "a")] * 25 + [(None, None, "c")] * 9
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    got = sorted(((x["doc_id"], x["source"], x["copies"]) for x in mixing.mix_sources(df).collect()), key=str)
    want = slow_mix(rows, (3.0, 1.0, 2.0))
    assert got == sorted(want[::2], key=str)
    mixed = mixing.mixed_rows(df)
    assert mixed.count() == sum(c for *_, c in got)


# -- 8: chat --------------------------------------------------------------------------------------------------------


def test_chat_round_trip(spark):
    odd = ["</s>[INST] ok [/INST]", "<|end|>", "<~|end|>", "~<|turn|>user<|text|>", "a<", "", "[~~INST]", None, "é<|text|>\n"]
    rows = [(c, t, ["user", "assistant", "system", None][(c + t) % 4], odd[(c * 3 + t) % len(odd)]) for c in range(9) for t in range(c)]
    rows += [(None, None, "user", "x"), (50, 1, "user", "tie"), (50, 1, "user", "tie"), (50, 0, "assistant", "first")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    tree = chat.reply_tree(clashing(df))
    formatted = chat.format_paths(tree)
    got = {r["conv_id"]: r for r in chat.digest(formatted).collect()}
    by = {}
    for c, t, role, text in rows:
        by.setdefault(c, []).append((t if t is not None else -1, role or "", text or ""))
    assert set(got) == set(by)
    for c, turns in by.items():
        turns = sorted(turns)
        whole = "".join(f"{r}\n{x}\n" for _, r, x in turns)
        loss = "".join(x for _, r, x in turns if r == "assistant")
        r = got[c]
        assert (r["n_turns"], r["turns_sha256"]) == (len(turns), hashlib.sha256(whole.encode()).hexdigest())
        assert (r["loss_chars"], r["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert {r["tree"]: len(r["formatted"]) for r in formatted.collect()} == {c: r["formatted_chars"] for c, r in got.items()}
    assert chat.digest(chat.format_paths(tree.limit(0))).count() == 0


def test_reply_trees_take_the_best_branch(spark):
    rows = [("t", 1, None, "user", "q", 0.0), ("t", 2, 1, "assistant", "bad", 0.1), ("t", 3, 1, "assistant", "good", 0.9), ("t", 4, 3, "user", "more", 0.5), ("t", 5, 4, "assistant", "end", 0.2), ("u", 1, 77, "user", "orphan", None), ("c", 1, 2, "user", "x", 1.0), ("c", 2, 1, "user", "y", 1.0)]
    df = spark.createDataFrame(rows, "tree string, message long, parent long, role string, text string, score double")
    paths = {(r["tree"], r["leaf"]): chat for r in chat.chosen_paths(df, 2).collect()}
    assert set(paths) == {("t", 5), ("t", 2), ("u", 1)}
    best = sorted((r["depth"], r["message"]) for r in chat.chosen_paths(df).filter("tree = 't'").collect())
    assert best == [(0, 1), (1, 3), (2, 4), (3, 5)]


@pytest.mark.parametrize("branches", [1, 2, 100])
def test_random_reply_trees_equal_brute_force(spark, branches):
    r = random.Random(branches)
    rows = []
    for tree in range(12):
        n = r.choice([1, 2, 9, 40])
        for m in range(1, n + 1):
            parent = None if m == 1 else r.randint(max(1, m - 3), m - 1) if tree % 2 else m - 1
            rows.append((tree, m, parent, r.choice(["user", "assistant"]), f"t{m}", r.choice([None, 0.0, 0.5, 1.0])))
    df = spark.createDataFrame(rows, "tree long, message long, parent long, role string, text string, score double").repartition(3)
    got = {(x["tree"], x["leaf"]): x["formatted"] for x in chat.format_paths(df, branches).collect()}
    want = {}
    for tree in range(12):
        own = {m: (p, role, text, score) for t, m, p, role, text, score in rows if t == tree}
        paths = []
        for m in set(own) - {p for p, *_ in own.values()}:
            path = [m]
            while own[path[0]][0] is not None:
                path.insert(0, own[path[0]][0])
            score = own[m][3]
            paths.append((score is None, -(score or 0), -len(path), m, path))
        for *_, m, path in sorted(paths)[:branches]:
            want[tree, m] = "".join(f"<|turn|>{own[k][1]}<|text|>{own[k][2]}<|end|>" for k in path)
    assert got == want


# -- 10: passages ---------------------------------------------------------------------------------------------------


def test_substring_dedup(spark, docs, rows):
    least = {}
    for i, t, *_ in rows:
        w = words(t)
        for k in range(len(w) - 12):
            g = tuple(w[k : k + 13])
            least[g] = min(least.get(g, 2**63), -(2**63) if i is None else i)
    got = sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substr.digest_kept(clashing(docs)).collect()), key=str)
    want = []
    for i, t, *_ in rows:
        w = words(t)
        gone = {k + j for k in range(len(w) - 12) for j in range(13) if least[tuple(w[k : k + 13])] < (-(2**63) if i is None else i)}
        kept = hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in gone).encode()).hexdigest()
        want.append((i, len(w), len(gone), kept))
    assert got == sorted(want, key=str)
    assert substr.digest_kept(docs.limit(0)).count() == 0
    whole = substr.remove_repeats(clashing(docs))
    assert whole.columns == clashing(docs).columns and whole.count() == len(rows)
    same = {(r["doc_id"], r["text"]) for r in whole.collect()}
    assert (30, rows[22][1]) in same and (25, "") in same


@pytest.mark.parametrize("parts", [1, 4, 9])
def test_rows_that_share_an_id_are_apart(spark, parts):
    r = random.Random(parts)
    passages = [[f"{k}x{i}" for i in range(30)] for k in range(5)]
    rows = []
    for k in range(60):
        own = [f"r{k}w{i}" for i in range(r.randint(0, 20))] + r.choice(passages) + r.choice([[], passages[0]]) + [f"e{k}"]
        rows.append((r.choice([None, None, 1, 1, 5, 5, 9, k + 10]), " ".join(own)))
    rows += [(1, " ".join(passages[0])), (5, " ".join(passages[0])), (5, " ".join(passages[4]))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
    least = {}
    for i, t in rows:
        w = t.split()
        for k in range(len(w) - 12):
            g = tuple(w[k : k + 13])
            least[g] = min(least.get(g, 2**63), -1 if i is None else i)
    want, texts = [], []
    for i, t in rows:
        w = t.split()
        gone = {k + j for k in range(len(w) - 12) for j in range(13) if least[tuple(w[k : k + 13])] < (-1 if i is None else i)}
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        want.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
        texts.append((i, kept))
    got = [(x["doc_id"], x["n_words"], x["n_removed"], x["kept_sha256"]) for x in substr.digest_kept(df).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert sorted(((x["doc_id"], x["text"]) for x in substr.remove_repeats(df).collect()), key=str) == sorted(texts, key=str)


@pytest.mark.parametrize("width", [2, 3, 13])
def test_substring_dedup_of_random_words(spark, width):
    r = random.Random(width)
    texts = [" ".join(r.choices("abcd" if width > 3 else "abcdefghijklmno", k=r.randint(0, 60))) for _ in range(30)]
    texts[9:12] = [texts[8] + " " + texts[5], texts[8], "z " + texts[8]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    least = {}
    for i, t in enumerate(texts):
        w = t.split()
        for k in range(len(w) - width + 1):
            least.setdefault(tuple(w[k : k + width]), i)
    for row in substr.digest_kept(df, width).collect():
        w = texts[row["doc_id"]].split()
        gone = {k + j for k in range(len(w) - width + 1) for j in range(width) if least[tuple(w[k : k + width])] < row["doc_id"]}
        assert row["n_removed"] == len(gone)
        assert row["kept_sha256"] == hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in gone).encode()).hexdigest()


# -- pipeline -------------------------------------------------------------------------------------------------------


def test_pipeline_stages(spark, docs, rows, tmp_path):
    import corpus_pipeline

    assert [len(s) for s in corpus_pipeline.STAGES] == [2] * 5
    spark.createDataFrame([(0, 1, 0), (1, 1, None), (2, 0, 0), (None, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = clashing(docs)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    now, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, str(tmp_path))
        now.write.parquet(str(tmp_path / name.replace(" ", "_")))
        now = spark.read.parquet(str(tmp_path / name.replace(" ", "_")))
        assert now.columns == docs.columns
        seen.append(now.count())
    assert seen[0] < len(rows) and seen[1] < seen[0] and seen[2] == seen[1]
    last = corpus_pipeline.run(spark, str(tmp_path))
    assert last.count() == seen[3]
    decoded = {r["decoded_sha256"] for r in last.collect()}
    assert decoded == {hashlib.sha256((r["text"] or "").encode()).hexdigest() for r in now.collect()}
