"""The queries of the training-data operators, and DuckDB SQL where SQL can express one on whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from glyphlake.llm import bpe, isomedia, licenses, neardup, packing, quality, rabitq, sharding, substrings, toxicity
from glyphlake.llm.workspace import read_documents


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(read_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op2_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.group(read_documents(spark, sf_dir), shingle=4)


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(read_documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op4_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return isomedia.digests(read_documents(spark, sf_dir))


def op5_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rabitq.search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(read_documents(spark, sf_dir))


def op7_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.digests(read_documents(spark, sf_dir))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(read_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, added_tokens=True)


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.summary(read_documents(spark, sf_dir))


QUERIES = {"op1_quality": op1_quality, "op2_neardup": op2_neardup, "op3_bpe": op3_bpe, "op4_media": op4_media, "op5_ann": op5_ann, "op6_sharding": op6_sharding, "op7_substrings": op7_substrings, "op8_toxicity": op8_toxicity, "op9_packing": op9_packing, "op10_licenses": op10_licenses}
_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"

#: Set similarity by a join on shingles, groups by a recursive closure.
OP2_SQL = f"""WITH RECURSIVE d AS (SELECT doc_id, {_WORDS.format("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w FROM documents),
  s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS l FROM d),
  u AS (SELECT doc_id, len(l) AS n, unnest(l) AS shingle FROM s),
  c AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS same FROM u a JOIN u b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY 1, 2),
  link AS (SELECT a, b FROM c WHERE 100 * same >= 80 * (na + nb - same)),
  reach AS (SELECT doc_id AS a, doc_id AS b FROM s UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a),
  g AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
  SELECT doc_id, len(l)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM s JOIN g USING (doc_id)"""

#: Windows counted over all documents, then the words that a recurring one covers.
OP7_SQL = f"""WITH d AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
  i AS (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS k FROM d WHERE len(w) >= 35),
  h AS (SELECT doc_id, k, md5(array_to_string(w[k:k + 34], ' ')) AS h FROM i),
  r AS (SELECT doc_id, k FROM h WHERE h IN (SELECT h FROM h GROUP BY h HAVING count(*) > 1)),
  g AS (SELECT DISTINCT doc_id, unnest(range(k, k + 35)) AS p FROM r),
  x AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
  t AS (SELECT x.doc_id, string_agg(word, ' ' ORDER BY x.p) AS t FROM x ANTI JOIN g ON x.doc_id = g.doc_id AND x.p = g.p GROUP BY x.doc_id),
  n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id)
  SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN t ON t.doc_id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id"""

ORACLE: dict[str, str] = {"op2_neardup": OP2_SQL, "op7_substrings": OP7_SQL}
