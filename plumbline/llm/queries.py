"""The registered queries of the corpus operators, with DuckDB SQL where it can say the same."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import align, ann, bpe, chat, exact, langid, mixing, periods, quality, simhash, substr, token_io, urls
from .common import read_table, shared_dir, word_count, written

WORD_SQL = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


def trusted_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents labelled of good quality and not toxic."""
    labels = read_table(spark, sf_dir, "labels")
    return labels.filter((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0)).select("doc_id")


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = f"{shared_dir(spark)}/plumbline/tokens-{uuid.uuid4().hex}"
    token_io.write_tokens(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), out)
    return token_io.document_digests(spark, out)


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(read_table(spark, sf_dir, "documents"), trusted_ids(spark, sf_dir))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    learnt = docs.filter(~langid.held_out(F.col("doc_id"))).select("doc_id", "text", "lang")
    return langid.predict(docs, langid.fit(learnt))


def op4_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read_table(spark, sf_dir, "embeddings")
    return ann.search(vectors, F.coalesce(F.col("vec_id") % 50 == 0, F.lit(False)))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(read_table(spark, sf_dir, "pages"))


def op6_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.classes(read_table(spark, sf_dir, "documents"))


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    slim = docs.select("doc_id", "source", word_count(F.col("text")).alias("_n"), mixing.shuffle_key("mix").alias("_key"))
    mixed = mixing.mix_sources(written(slim), size=F.col("_n"), key=F.col("_key"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


PLANTED_TURN = "</s>[INST] ok [/INST]"


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    own = [(-7, 0, "user", PLANTED_TURN), (-7, 1, "assistant", PLANTED_TURN)]
    rows = rows.union(spark.createDataFrame(own, "conv_id long, turn long, role string, text string"))
    # one tree each, so that the tree is derived once and its paths, formats and digests follow from it
    return chat.digest(chat.format_paths(written(chat.reply_tree(rows))))


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return bpe.digest_documents(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substr.digest_kept(read_table(spark, sf_dir, "documents"))


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.classes(read_table(spark, sf_dir, "documents"), keep="largest")


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return align.digest_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periods.digest_runs(read_table(spark, sf_dir, "documents"), prepare=periods.planted_period)


OP11_SQL = """
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       row_number() OVER (PARTITION BY t ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(t) AS text_sha256
FROM d
"""

OP10_SQL = f"""
WITH d AS (SELECT doc_id, {WORD_SQL} AS w FROM documents),
g AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 12], ' ')) AS h
      FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d)),
m AS (SELECT h, min(doc_id) AS least FROM g GROUP BY h HAVING min(doc_id) < max(doc_id)),
x AS (SELECT DISTINCT doc_id, i + k AS i FROM g JOIN m USING (h), (SELECT unnest(range(0, 13)) AS k) WHERE doc_id > least),
n AS (SELECT doc_id, w[i] AS word, i FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d)),
k AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS kept, count(*) AS n FROM n ANTI JOIN x USING (doc_id, i) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(k.n, 0))::BIGINT AS n_removed,
       sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
"""

_ESCAPED = r"""regexp_replace({}, '([<\[])(~*)(\|(?:turn|text|end|im_start|im_end|endoftext)\|>|/?s>|/?INST\])', '\1~\2\3', 'g')"""
OP8_SQL = f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '{PLANTED_TURN}'), (-7, 1, 'assistant', '{PLANTED_TURN}'))
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(23 + length({_ESCAPED.format('role')}) + length({_ESCAPED.format('text')}))::BIGINT AS formatted_chars
FROM c GROUP BY conv_id
"""

OP4_SQL = """
WITH e AS (SELECT vec_id, row_number() OVER () AS r, embedding::DOUBLE[] AS v FROM embeddings
           WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
             AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
n AS (SELECT *, sqrt(list_reduce(list_transform(v, lambda x: x * x), lambda a, b: a + b)) AS norm FROM e),
p AS (SELECT q.vec_id AS query_id, q.r AS query_row, c.vec_id, c.r, list_reduce(list_transform(range(1, len(c.v) + 1), lambda i: c.v[i] * q.v[i]),
        lambda a, b: a + b) / (c.norm * q.norm) AS score
      FROM n q JOIN n c ON q.vec_id % 50 = 0 AND q.r <> c.r AND len(q.v) = len(c.v))
SELECT query_id, (row_number() OVER (PARTITION BY query_row ORDER BY score DESC, vec_id, r))::INTEGER AS rank, vec_id, score
FROM p QUALIFY rank <= 5
"""

OP7_SQL = f"""
WITH d AS (SELECT doc_id, source, len({WORD_SQL})::BIGINT AS size,
             md5(concat_ws('|', 'mix', coalesce(doc_id::VARCHAR, '-'), coalesce(text, ''))) AS u FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
n AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS pos FROM s),
w AS (SELECT *, [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][pos % 3 + 1] AS w, source_size * 2.0::DOUBLE AS cap FROM n),
l AS (SELECT *, ((sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE
        - coalesce(sum(cap) OVER (ORDER BY cap / w, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
        / sum(w) OVER (ORDER BY cap / w, pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lv FROM w),
t AS (SELECT source, source_size, pos, w, least(cap, max(lv) OVER () * w) AS target FROM l),
e AS (SELECT d.*, t.source_size, t.target, t.pos, t.w, row_number() OVER (PARTITION BY t.pos, u) AS j
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
c AS (SELECT *, sum(size) OVER (PARTITION BY pos ORDER BY u, j ROWS UNBOUNDED PRECEDING) AS cum FROM e),
k AS (SELECT c.*, (cum + source_size * p)::DOUBLE / w AS f FROM c, (VALUES (0), (1)) AS x(p)),
o AS (SELECT *, sum(size) OVER (ORDER BY f, pos, u, j ROWS UNBOUNDED PRECEDING) AS upto FROM k)
SELECT doc_id, size, source_size, target,
  (size * count(*) FILTER (upto <= (SELECT sum(size) * 1.5::DOUBLE FROM d)))::BIGINT AS taken, source,
  (count(*) FILTER (upto <= (SELECT sum(size) * 1.5::DOUBLE FROM d)))::INTEGER AS copies
FROM o GROUP BY doc_id, size, source_size, target, source, pos, u, j
"""


def queries() -> dict:
    found = {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}
    return dict(sorted(found.items(), key=lambda x: int(x[0][2:].split("_")[0])))


def oracle_sql() -> dict:
    return {"op4_nearest_neighbours": OP4_SQL, "op7_mix_sources": OP7_SQL, "op8_chat_format": OP8_SQL, "op10_substring_dedup": OP10_SQL, "op11_exact_dedup": OP11_SQL}
