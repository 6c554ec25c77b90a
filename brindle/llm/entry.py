"""Queries of this subpackage, for __spark_entry__.py. Columns of a contract come first; parameters are production's."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, chat, langid, licenses, line_dedup, media, mixing, neardup, pieces, url_filter
from .common import table

#: Where the tokenizer's model is; the driver reads it.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, sf_dir, "pages"), url_filter.rules_table(spark))


def op2_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_columns(table(spark, sf_dir, "documents"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.classes(table(spark, sf_dir, "documents"))


def op5_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"))


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_texts(table(spark, sf_dir, "documents"), pieces.read_model(MODEL))


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sizes(table(spark, sf_dir, "documents"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = licenses.scan_licenses(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def held_out(doc_id) -> F.Column:
    """Whether a document is kept from learning: crc32 of its id as text, modulo 4, is 2. Null ids aren't held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def language_model(docs: DataFrame) -> langid.Model:
    return langid.fit(docs.where(~held_out(F.col("doc_id"))))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = langid.predict(docs, language_model(docs))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "mixture")


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(table(spark, sf_dir, "conversations"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_url_filters, op2_media_columns, op3_line_dedup, op4_minhash_near_dedup, op5_nearest_neighbours, op6_sentencepiece, op7_source_mixing, op8_license_scan, op9_language_id, op10_chat_format, pipeline)
    return {f.__name__: f for f in own}


OP1 = r"""
WITH r(h, p, verdict) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
u AS (SELECT row_number() OVER () AS k, page_id, coalesce(url, '') AS url FROM pages),
s AS (SELECT k, page_id, translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM u),
m AS (SELECT s.*, r.h || r.p AS rule, r.verdict, row_number() OVER (PARTITION BY k ORDER BY length(r.h || r.p) DESC, length(r.h) DESC, r.verdict DESC) AS n FROM s LEFT JOIN r ON (s.host = r.h OR ends_with(s.host, '.' || r.h)) AND starts_with(s.path, r.p))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM m WHERE n = 1
"""

OP3 = r"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT k, doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS pos FROM d),
n AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
c AS (SELECT key, max(doc_id) AS keeper FROM n WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
m AS (SELECT n.*, c.keeper IS NOT NULL AND n.doc_id IS DISTINCT FROM c.keeper AS gone FROM n LEFT JOIN c USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256 FROM m GROUP BY k, doc_id
"""

OP10 = r"""
WITH f AS (SELECT DISTINCT conv_id, turn, role, text, coalesce(length(role) || ':' || role, '-') AS r, coalesce(length(text) || ':' || text, '-') AS t FROM conversations),
g AS (SELECT conv_id, list(r || '|' || t ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS x, list('<|im_start|>' || replace(replace(coalesce(role, 'unknown'), '<|im_start|>', '<​|im_start|>'), '<|im_end|>', '<​|im_end|>') || chr(10) || replace(replace(coalesce(text, ''), '<|im_start|>', '<​|im_start|>'), '<|im_end|>', '<​|im_end|>') || '<|im_end|>' || chr(10) ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS y FROM f GROUP BY conv_id),
e AS (SELECT x, unnest(range(1, len(x) + 1)) AS k FROM g),
h AS (SELECT x, k, md5(x[1]) AS last FROM e WHERE k = 1),
s AS (SELECT DISTINCT x[1:k] AS x FROM e WHERE k < len(x)),
w AS (SELECT x, count(*) AS n_copies, min(conv_id) AS conv_id FROM g GROUP BY x)
SELECT w.conv_id, cast(len(w.x) AS bigint) AS n_turns, w.n_copies, list_reduce(list_prepend('', w.x), lambda a, b: md5(a || b)) AS chat_hash, array_to_string(g.y, '') AS rendered
FROM w JOIN g ON w.conv_id IS NOT DISTINCT FROM g.conv_id WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.x = w.x)
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_url_filters": OP1, "op3_line_dedup": OP3, "op10_chat_format": OP10}
