"""Registered queries of the training-data operators and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from ..plans.registry import Registry
from .byte_bpe import encode_documents
from .centroids import cluster_rows
from .chat import conversation_digests
from .common import crc_mod, table
from .embedding_dedup import link_embeddings
from .exact_dedup import exact_dedup
from .hard_negatives import mine
from .html_extract import extract_pages
from .language_id import fit as fit_languages, identify
from .minhash_dedup import near_duplicates
from .packing import pack
from .quality import fit as fit_quality, score as score_quality
from .toxicity import fit as fit_toxicity, score as score_toxicity
from .warc import page_roles

R = Registry()

_OP6 = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM d WINDOW w AS (PARTITION BY t)
"""


@R.add("op6_exact_dedup", _OP6)
def op6_exact_dedup(spark, sf_dir):
    return exact_dedup(table(spark, sf_dir, "documents"))


@R.add("op3_byte_bpe")
def op3_byte_bpe(spark, sf_dir):
    return encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, ids=False)


@R.add("op8_html_extract")
def op8_html_extract(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    # The url rides along under a name of its own: one pass over the pages, no join.
    return extract_pages(pages, carry=["url"]).select("page_id", "url", "text", "n_chars")


@R.add("op10_harmonic_packing")
def op10_harmonic_packing(spark, sf_dir):
    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


_OP7 = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), e AS (
  SELECT *, length(regexp_replace(text, '([\\<\[])', '\\\1', 'g')) AS e, length(regexp_replace(role, '([\\<\[])', '\\\1', 'g')) AS r FROM c
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(3 + sum(CASE role WHEN 'user' THEN e + 15 WHEN 'assistant' THEN e + 5 ELSE e + r + 14 END) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""


@R.add("op7_chat_format", _OP7)
def op7_chat_format(spark, sf_dir):
    told = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    added = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], told.schema)
    return conversation_digests(told.unionByName(added))


@R.add("op2_language_id")
def op2_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    held = F.coalesce(crc_mod("doc_id", 4) == 2, F.lit(False))
    model = fit_languages(docs, "lang", "text", ~held & F.col("doc_id").isNotNull())
    return identify(docs, model).select("doc_id", held.alias("held_out"), "lang_pred", "score", "ambiguous")


@R.add("op5_quality_crf")
def op5_quality_crf(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    held = F.coalesce(crc_mod("doc_id", 3) == 1, F.lit(False))
    model = fit_quality(docs, table(spark, sf_dir, "labels"), ~held & F.col("doc_id").isNotNull())
    return score_quality(docs, model).select("doc_id", held.alias("held_out"), "score", "predicted", "n_lines", "n_bad_lines")


@R.add("op9_toxicity_mil")
def op9_toxicity_mil(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    held = F.coalesce(crc_mod("doc_id", 5) == 0, F.lit(False))
    model = fit_toxicity(docs, table(spark, sf_dir, "labels"), ~held & F.col("doc_id").isNotNull())
    return score_toxicity(docs, model).select("doc_id", held.alias("held_out"), "score", "predicted", "n_sentences", F.size("offending").alias("n_offending"))


@R.add("op1_embedding_dedup")
def op1_embedding_dedup(spark, sf_dir):
    return link_embeddings(table(spark, sf_dir, "embeddings"))


@R.add("op4_minhash_dedup")
def op4_minhash_dedup(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"))


def _op11_round(i: int) -> str:
    """Assignment to the centroids of round i, and the centroids after it."""
    return f"""
d{i} AS MATERIALIZED (SELECT vec_id, c, sum((x.x - c{i}.x) * (x.x - c{i}.x)) AS d FROM x JOIN c{i} USING (pos) GROUP BY ALL),
a{i} AS MATERIALIZED (SELECT vec_id, d, c FROM d{i} QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, c) = 1),
m{i} AS (SELECT c, pos, sum(x) AS s, count(*) AS n FROM a{i} JOIN x USING (vec_id) GROUP BY ALL),
c{i + 1} AS MATERIALIZED (SELECT c, pos, CASE WHEN n IS NULL THEN x ELSE (s - (s % n + n) % n) // n END AS x FROM c{i} LEFT JOIN m{i} USING (c, pos))"""


_OP11 = f"""
WITH e AS (SELECT vec_id, list_transform(embedding, lambda v: floor(64 * v::DOUBLE)::HUGEINT) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda v: v IS NOT NULL AND isfinite(v))) = 64),
x AS MATERIALIZED (SELECT vec_id, unnest(range(64)) AS pos, unnest(v) AS x FROM e),
s AS (SELECT vec_id, row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS c FROM e QUALIFY c < 16),
c0 AS MATERIALIZED (SELECT c, pos, x FROM s JOIN x USING (vec_id)), {_op11_round(0)}, {_op11_round(1)}, {_op11_round(2)}, {_op11_round(3)},
h AS (SELECT c, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY pos)) AS centroid_sha256 FROM c3 GROUP BY c)
SELECT vec_id, CAST(c AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia,
  CAST(sum(d) OVER () AS BIGINT) AS inertia, centroid_sha256 FROM a3 JOIN h USING (c)
"""


@R.add("op11_centroid_clusters", _OP11)
def op11_centroid_clusters(spark, sf_dir):
    return cluster_rows(table(spark, sf_dir, "embeddings"))


_OP12 = """
WITH e AS (SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda v: floor(256 * v::DOUBLE)) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(list_filter(embedding, lambda v: v IS NOT NULL AND isfinite(v))) = len(embedding)),
s AS MATERIALIZED (SELECT a.id AS anchor_id, b.id, a.label = b.label AS same, CAST(list_dot_product(a.x, b.x) AS BIGINT) AS score FROM e a JOIN e b ON a.id % 50 = 0 AND a.id <> b.id),
p AS (SELECT anchor_id, id, score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, p.id AS positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, s.id AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score
WINDOW w AS (PARTITION BY anchor_id, p.id ORDER BY s.score DESC, s.id) QUALIFY row_number() OVER w <= 3
"""


@R.add("op12_hard_negatives", _OP12)
def op12_hard_negatives(spark, sf_dir):
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(table(spark, sf_dir, "embeddings").withColumn("label", moved), F.col("vec_id") % 50 == 0)


_OP13 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS t, sha1(coalesce(html, '')) AS h FROM pages), r AS (SELECT *, min(page_id) OVER (PARTITION BY t) AS f FROM p)
SELECT page_id, CAST(octet_length(encode(t)) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST('0x' || substr(h, 5 * (k // 4) + 1, 5) AS BIGINT) >> (15 - 5 * (k % 4))) & 31 AS INTEGER) + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id IS NOT DISTINCT FROM f THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id IS DISTINCT FROM f THEN f END AS refers_to FROM r
"""


@R.add("op13_warc_bundles", _OP13)
def op13_warc_bundles(spark, sf_dir):
    return page_roles(table(spark, sf_dir, "pages"), least_bytes=0)
