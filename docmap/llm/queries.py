"""Registered queries of this subpackage and their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docmap.llm import bpe as _bpe
from docmap.llm import chat_format as _chat
from docmap.llm import exact_dedup as _exact
from docmap.llm import html_text as _html
from docmap.llm import jaccard_join as _jaccard
from docmap.llm import language_id as _language
from docmap.llm import ngram_lm as _lm
from docmap.llm import packing as _packing
from docmap.llm import periodic_runs as _periods
from docmap.llm import sentence_dedup as _sentences
from docmap.llm import token_alignment as _alignment
from docmap.llm import toxicity as _toxicity
from docmap.llm import vector_search as _vectors
from docmap.llm.common import LOWER, UPPER, read_table


TOKENIZER = "word_bpe_49k.json"


def remainder(divisor: int):
    """crc32 of doc_id as text, modulo ``divisor``."""
    return F.crc32(F.col("doc_id").cast("string")) % divisor


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = _language.fit_language_model(docs.filter(remainder(5) != 0))
    return _language.label_languages(docs, model).select(
        "doc_id", F.coalesce(remainder(5) == 0, F.lit(False)).alias("held_out"), "lang_pred", "score",
        F.size("spans").alias("n_spans"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = _packing.pack_texts(read_table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


def op3_sentence_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return _sentences.drop_repeated_sentences(docs, count_as="n_removed")


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bpe.bpe_digest(read_table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _exact.exact_dedup(read_table(spark, sf_dir, "documents"), keep="largest")


def op7_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _vectors.nearest_vectors(read_table(spark, sf_dir, "embeddings"), F.col("_id") % 50 == 0)


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _html.extract_main_text(read_table(spark, sf_dir, "pages"))


def toxicity_model(spark: SparkSession, sf_dir: str) -> _toxicity.Model:
    """Fitted on the labelled documents outside the held-out quarter."""
    learn = remainder(4) != 2
    return _toxicity.fit_toxicity(read_table(spark, sf_dir, "documents").select("doc_id", "text").filter(learn),
                                  read_table(spark, sf_dir, "labels").filter(learn))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = _toxicity.score_toxicity(read_table(spark, sf_dir, "documents"), toxicity_model(spark, sf_dir))
    return scored.select("doc_id", F.coalesce(remainder(4) == 2, F.lit(False)).alias("held_out"), "score",
                         (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op4_ngram_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = _lm.score_documents(read_table(spark, sf_dir, "documents"))
    # sums of floating-point numbers: rounded, as their order is free
    return scored.withColumns({c: F.round(c, 4) for c in ("log_score", "mean_log_score")})


OP4_SQL = f"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x20\\x09-\\x0D]+') AS ws
  FROM documents),
words AS (SELECT r, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM docs),
grams AS (
  SELECT r, w, lag(w) OVER (PARTITION BY r ORDER BY i) AS w1, lag(w, 2) OVER (PARTITION BY r ORDER BY i) AS w2
  FROM words),
c1 AS (SELECT w, count(*) AS n FROM grams GROUP BY w),
c2 AS (SELECT w1, w, count(*) AS n FROM grams WHERE w1 IS NOT NULL GROUP BY w1, w),
c3 AS (SELECT w2, w1, w, count(*) AS n FROM grams WHERE w2 IS NOT NULL GROUP BY w2, w1, w),
counted AS (
  SELECT g.*, a.n AS a, a1.n AS a1, b.n AS b, b1.n AS b1, c.n AS c
  FROM grams g JOIN c1 a ON g.w = a.w LEFT JOIN c1 a1 ON g.w1 = a1.w
  LEFT JOIN c2 b ON g.w1 = b.w1 AND g.w = b.w LEFT JOIN c2 b1 ON g.w2 = b1.w1 AND g.w1 = b1.w
  LEFT JOIN c3 c ON g.w2 = c.w2 AND g.w1 = c.w1 AND g.w = c.w),
one AS (SELECT *, ln(a / (SELECT sum(n) FROM c1)::DOUBLE) AS s1 FROM counted),
two AS (SELECT *, CASE WHEN w1 IS NULL THEN s1 WHEN b >= 2 THEN ln(b / a1::DOUBLE) ELSE ln(0.4) + s1 END AS s2 FROM one),
three AS (SELECT r, CASE WHEN w2 IS NULL THEN s2 WHEN c >= 2 THEN ln(c / b1::DOUBLE) ELSE ln(0.4) + s2 END AS s FROM two),
sums AS (SELECT r, count(*) AS n, sum(s) AS s FROM three GROUP BY r)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_words, round(coalesce(s, 0.0), 4)::DOUBLE AS log_score,
       round(s / n, 4)::DOUBLE AS mean_log_score
FROM docs LEFT JOIN sums USING (r)
"""


OP5_SQL = f"""
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
FROM (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS norm FROM documents)
WINDOW w AS (PARTITION BY norm)
"""

def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _jaccard.similarity_components(read_table(spark, sf_dir, "documents"))


def op11_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = r"\### Assistant: </turn> ok"
    planted = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], turns.schema)
    return _chat.read_back(_chat.format_conversations(turns.unionByName(planted)))


OP11_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text,
         CASE WHEN conv_id IS NULL THEN row_number() OVER () END AS own
  FROM (SELECT conv_id, turn, role, text FROM conversations
        UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
        UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok')),
sized AS (
  SELECT *, length(text) + length(text) - length(replace(text, '\', ''))
            + length(text) - length(regexp_replace(text, '#{3,}', '', 'g'))
            + (length(text) - length(replace(text, '</turn>', ''))) // 7
            + length(role) + length(role) - length(replace(replace(role, '\', ''), ':', ''))
            + length(role) - length(regexp_replace(role, '#{3,}', '', 'g'))
            + (length(role) - length(replace(role, '</turn>', ''))) // 7 + 14 AS chars
  FROM t)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum(chars)::BIGINT AS formatted_chars
FROM sized GROUP BY conv_id, own
"""


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _alignment.align_tokenizers(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"),
                                       public_tokenizers.path("piece_bpe_32k.model"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    docs = docs.withColumn("text", _periods.with_planted_period(F.col("text"), F.col("doc_id")))
    return _periods.run_report(_periods.periodic_runs(docs))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": op1_language_id,
    "op2_packing": op2_packing,
    "op3_sentence_dedup": op3_sentence_dedup,
    "op4_ngram_lm": op4_ngram_lm,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_bpe": op6_bpe,
    "op7_vector_search": op7_vector_search,
    "op8_html_text": op8_html_text,
    "op9_toxicity": op9_toxicity,
    "op10_jaccard_join": op10_jaccard_join,
    "op11_chat_format": op11_chat_format,
    "op12_token_alignment": op12_token_alignment,
    "op13_periodic_runs": op13_periodic_runs,
}
ORACLE_SQL: dict[str, str] = {
    "op11_chat_format": OP11_SQL,
    "op4_ngram_lm": OP4_SQL,
    "op5_exact_dedup": OP5_SQL,
}
