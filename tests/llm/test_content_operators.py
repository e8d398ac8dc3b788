"""Exact dedup, cross-tokenizer alignment and periodic runs against brute-force versions, with nulls, ties, repeats,
long texts, empty tables and clashing columns."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
import public_tokenizers as P
from pyspark.sql import functions as F

from plumbline.llm import align, exact, periods

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
A_PATH, B_PATH = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")


def prose(seed, n):
    r = random.Random(seed)
    return " ".join("".join(r.choices(["th", "er", "on", "An", "re", "sh", "é", "Ñ"], k=r.randint(1, 4))) for _ in range(n))


def lower(text):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")


@pytest.fixture(scope="module")
def rows():
    out = [(i, prose(i, 20 + 9 * i)) for i in range(10)]
    out += [
        (20, None), (21, ""), (22, " \t\n\x0b\x0c\r "), (23, "one"), (24, "ONE"), (25, "É one"), (26, "é one"), (27, "É ONE"),
        (28, "x" * 5000 + "a"), (29, "x" * 5000 + "b"),  # one long beginning
        (30, "A  b c d   \n\n e's <s> <|endoftext|> </s> <0x41> 漢字😀\x1c\x85　z "), (31, "a ▁ b"), (32, "  two  blanks "),
        (33, "\x00 null ﻿ mark é ﬁ ½ 123 4567"), (34, "la " * 400), (35, "a b c " * 50 + "d " * 9 + "e f " * 3), (36, "k " * 6), (37, "k " * 5),
        (38, prose(77, 20_000)), (38, "again the id"), (None, prose(3, 47)), (None, None), (None, "k " * 6), (39, "one"), (39, "one"),
    ]
    out += [(1000 + i, "the same HOT text" if i % 2 else "the same hot text") for i in range(700)]  # more than the limit of a hot digest
    out += [(None, "only nulls"), (None, "only NULLS")]
    return [(d, t, "en", "s", 1) for d, t in out]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(3)


def clashing(df):
    names = "row sha salt run best n norm lead begins block keys pairs at key a b m links values start length period n_runs kept _row bytes text_sha256".split()
    return df.withColumns({c: F.lit("x") for c in names})


def as_rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


# exact dedup


@pytest.mark.parametrize("keep", ["largest", "smallest"])
def test_exact_classes(docs, rows, keep):
    groups = defaultdict(list)
    for d, t, *_ in rows:
        groups[lower(t)].append(d)
    got = exact.classes(clashing(docs), keep).collect()
    assert len(got) == len(rows)
    by_sha = defaultdict(list)
    for r in got:
        by_sha[r.text_sha256].append(r)
    assert {hashlib.sha256(t.encode()).hexdigest() for t in groups} == set(by_sha)
    for text, ids in groups.items():
        own = by_sha[hashlib.sha256(text.encode()).hexdigest()]
        named = [d for d in ids if d is not None]
        least = (max if keep == "largest" else min)(named) if named else None
        assert Counter(r.doc_id for r in own) == Counter(ids)
        assert {(r.keep_id, r.group_size) for r in own} == {(least, len(ids))}
        assert [r.doc_id for r in own if r.kept] == [least]


def test_exact_rows_stay_whole(docs, rows):
    got = exact.deduplicated(clashing(docs)).collect()
    assert len(got) == len({lower(t) for _, t, *_ in rows}) and got[0].salt == "x"
    assert len(got[0]) == len(clashing(docs).columns)


def test_equal_digests_do_not_make_texts_equal(docs, rows, monkeypatch):
    """With one digest for all texts, hot or not, the bytes still decide."""
    monkeypatch.setattr(F, "sha2", lambda c, n: F.lit("same"))
    got = exact.classes(docs).collect()
    assert Counter(r.group_size for r in got if r.kept) == Counter(Counter(lower(t) for _, t, *_ in rows).values())


def test_exact_empty_table(spark):
    empty = spark.createDataFrame([], DOCS)
    assert exact.classes(empty).count() == 0 and exact.deduplicated(empty).columns == empty.columns


# alignment


def aligned(rows):
    """Per row the tokens, groups and links by whole texts; then the digests."""
    import sentencepiece
    from tokenizers import Tokenizer

    tok_a = Tokenizer.from_file(A_PATH)
    tok_a.encode_special_tokens = True
    tok_b = sentencepiece.SentencePieceProcessor(model_file=B_PATH)
    letters = align._byte_letters()
    bytes_a = lambda i: bytes(letters[c] for c in tok_a.id_to_token(i))
    bytes_b = lambda i: bytes([int(tok_b.id_to_piece(i)[3:5], 16)]) if tok_b.is_byte(i) else tok_b.id_to_piece(i).replace("▁", " ").encode()
    per, holds = [], Counter()
    for _, text, *_ in rows:
        a = tok_a.encode(" " + text, add_special_tokens=False).ids if text else []
        b = tok_b.encode(text) if text else []
        raw = (" " + text).encode() if text else b""
        if not text or b"".join(map(bytes_a, a)) != raw or b"".join(map(bytes_b, b)) != raw:
            per.append(None)
            continue
        ends_a, ends_b = np.cumsum([len(bytes_a(i)) for i in a]), np.cumsum([len(bytes_b(i)) for i in b])
        links, groups, last_a, last_b, i = [], [], 0, 0, 0
        for j, id_b in enumerate(b):
            begin, end = (ends_b[j - 1] if j else 0), ends_b[j]
            while ends_a[i] <= begin:
                i += 1
            k = i
            while k < len(a) and (ends_a[k - 1] if k else 0) < end:
                links.append((a[k], id_b))
                k += 1
            if ends_a[k - 1] == end:
                groups.append(f"{','.join(map(str, a[last_a:k]))}|{','.join(map(str, b[last_b : j + 1]))}")
                last_a, last_b = k, j + 1
        per.append((a, b, groups, links))
        holds.update(set(links))
    top = defaultdict(int)
    for (x, _), n in holds.items():
        top[x] = max(top[x], n)
    out = []
    for (d, *_), v in zip(rows, per, strict=True):
        if v is None:
            out.append((d, 0, 0, 0, 0, 0, 0, ""))
        else:
            a, b, groups, links = v
            best = sum(holds[x] == top[x[0]] for x in links)
            out.append((d, len(a), len(b), len(groups), len(links), best, sum(holds[x] for x in links), hashlib.sha256(";".join(groups).encode()).hexdigest()))
    return out


def test_alignment(docs, rows):
    got = as_rows(align.digest_documents(clashing(docs), A_PATH, B_PATH))
    want = sorted(aligned(rows), key=str)
    assert got == want
    assert sum(r[1] == 0 for r in want) >= 4 and any(r[4] > r[3] for r in want)


def test_alignment_of_odd_characters(spark):
    r = random.Random(4)
    letters = [*"ab'.,19 \t\n", " ", " ", "é", "漢", "😀", " ", "\x1f", "​", "<s>", "▁", "'s", "́", "ß"]
    rows = [(i, "".join(r.choices(letters, k=r.randint(1, 60))), "en", "s", 1) for i in range(400)]
    assert as_rows(align.digest_documents(spark.createDataFrame(rows, DOCS).repartition(3), A_PATH, B_PATH)) == sorted(aligned(rows), key=str)


def test_alignment_in_small_blocks(docs, rows, monkeypatch):
    """Counts add up over blocks."""
    whole = as_rows(align.digest_documents(docs, A_PATH, B_PATH))
    assert as_rows(align.digest_documents(docs.repartition(7), A_PATH, B_PATH)) == whole


def test_alignment_has_no_row_that_grows_with_its_block(spark):
    """A block of many documents travels as small rows."""
    rows = [(i, f"some words of text number {i % 50}") for i in range(3000)]
    parts = align._blocks(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), A_PATH, B_PATH)
    assert parts.agg(F.max(F.length(F.to_json(F.struct(*parts.columns))))).first()[0] < 2000


def test_alignment_of_an_empty_table(spark):
    got = align.digest_documents(spark.createDataFrame([], DOCS), A_PATH, B_PATH)
    assert got.count() == 0 and got.columns[0] == "doc_id"


# periodic runs


def brute_runs(words, least=6, exponent=4):
    n, out = len(words), []
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(least, exponent * q):
                smaller = any(all(words[k] == words[k + r] for k in range(i, i + length - r)) for r in range(1, q))
                if not smaller:
                    out.append((i, length, q))
            i = j + 1
    return sorted(out, key=lambda x: (x[0], x[2]))


@pytest.mark.parametrize("exponent", [2, 3, 4, 6])
def test_refinement_finds_all_runs(exponent):
    r = random.Random(exponent)
    for _ in range(400):
        texts = []
        for _ in range(r.randint(1, 5)):
            n = r.randint(0, 70)
            own = [r.randrange(r.randint(1, 4)) for _ in range(n)]
            if n and r.random() < 0.7:
                begin, q = r.randrange(n), r.randint(1, 14)
                for k in range(begin + q, n):
                    own[k] = own[k - q]
            texts.append(own)
        got = [[] for _ in texts]
        for d, *run in zip(*(c.tolist() for c in periods.runs_of(np.array(sum(texts, []), np.int64), np.array([len(t) for t in texts]), 6, exponent)), strict=True):
            got[d].append(tuple(run))
        assert got == [brute_runs(t, 6, exponent) for t in texts]


def digests(doc_id, text, planted):
    words = WORD.findall(text or "")
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if planted and h % 10 == 0 and words:
        g, n = h // 10, len(words)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = brute_runs(words) if len(words) < 3000 else brute_long(words)
    gone = {k for s, n, q in runs for k in range(s + q, s + n)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    top = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    kept = " ".join(w for k, w in enumerate(words) if k not in gone)
    return (doc_id, len(runs), *top, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


def brute_long(words):
    """The same by numpy, for long texts: stretches of equality at each distance; no period divides another here."""
    x, out = np.unique(words, return_inverse=True)[1], []
    for q in range(1, len(x) // 4 + 1):
        same = np.append(np.append(False, x[q:] == x[:-q]), False)
        begins, ends = np.flatnonzero(~same[:-1] & same[1:]), np.flatnonzero(same[:-1] & ~same[1:])
        for i, j in zip(begins.tolist(), ends.tolist(), strict=True):
            if j - i + q >= max(6, 4 * q) and not any(s <= i and i + j - i + q <= s + n and q % p == 0 for s, n, p in out):
                out.append((i, j - i + q, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize("planted", [True, False])
def test_run_digests(docs, rows, planted):
    some = [(d, t) for d, t, *_ in rows if d is None or d < 1000]
    got = periods.digest_runs(clashing(docs).filter("doc_id is null or doc_id < 1000"), periods.planted_period if planted else None)
    want = sorted((digests(d, t, planted) for d, t in some), key=str)
    assert as_rows(got) == want and any(r[1] > 1 for r in want)


def test_planted_periods_are_found(spark):
    rows = [(i, prose(i, 300), "en", "s", 1) for i in range(300)]
    df = spark.createDataFrame(rows, DOCS)
    got = as_rows(periods.digest_runs(df, periods.planted_period))
    assert got == sorted((digests(d, t, True) for d, t, *_ in rows), key=str)
    listed = periods.runs(df, periods.planted_period).collect()
    assert len(listed) == sum(r[1] for r in got) > 10


def test_collapsed_texts(docs):
    got = {r.doc_id: r for r in periods.collapsed(clashing(docs)).filter("doc_id in (34, 35, 36, 37, 20, 9)").collect()}
    assert got[34].text == "la" and got[35].text == "a b c d e f e f e f" and got[36].text == "k"
    assert got[37].text == "k " * 5 and got[20].text is None and got[9].text == prose(9, 101) and got[9].row == "x"


def test_runs_of_an_empty_table(spark):
    empty = spark.createDataFrame([], DOCS)
    assert periods.digest_runs(empty).count() == 0 and periods.runs(empty).count() == 0 and periods.collapsed(empty).columns == empty.columns
