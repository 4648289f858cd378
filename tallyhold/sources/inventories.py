"""Inventories derived from the documents table, for queries, tests and the bench; every document is in each of them.

Object keys are ``lang/source/doc-<id>.txt``. In the target German documents lie in other folders, French
ones have other bytes of equal length, and those of one source are a byte longer; the prior manifest knows
nothing of Spanish ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import stand_in_hash
from ..session import table

STAMP = "stat-v1:2026-01-01T00:00:00.0000000Z:"


def _text() -> Column:
    return F.coalesce("text", F.lit(""))


def _key(folder: Column) -> Column:
    return F.concat("lang", F.lit("/"), folder, F.lit("/doc-"), F.col("doc_id").cast("string"), F.lit(".txt"))


def _target_text() -> Column:
    return F.when(F.col("lang") == "fr", F.replace(_text(), F.lit("e"), F.lit("a"))).when(F.col("source") == "src7", F.concat(_text(), F.lit("!"))).otherwise(_text())


def _rows(docs: DataFrame, path: Column, text: Column) -> DataFrame:
    length = F.octet_length(text).cast("long")
    return docs.select(path.alias("path"), length.alias("length"), stand_in_hash(text).alias("hash"), F.concat(F.lit(STAMP), F.octet_length(_text()).cast("string")).alias("fingerprint"))


def source_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(table(spark, sf_dir, "documents"), _key(F.col("source")), _text())


def target_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = F.when(F.col("lang") == "de", F.concat(F.lit("old-"), F.col("source"))).otherwise(F.col("source"))
    return _rows(table(spark, sf_dir, "documents"), _key(folder), _target_text())


def prior_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = table(spark, sf_dir, "documents").filter("lang <> 'es'")
    return _rows(known, _key(F.col("source")), _target_text())


def history_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a stored object of a history branch, by language."""
    docs = table(spark, sf_dir, "documents")
    path = F.concat(F.lit("20260818T100000Z"), F.when(F.col("lang") == "en", "").otherwise("-1"), F.lit("/"), _key(F.col("source")))
    return docs.select(path.alias("relative_path"), stand_in_hash(_text()).alias("content_hash"), F.octet_length(_text()).cast("long").alias("content_length"), F.lit("materialized").alias("representation"), F.lit(True).alias("eligible"))


_HASH = "'xxh128:' || replace(replace(rtrim(to_base64(unhex(md5({0}))), '='), '+', '-'), '/', '_')"
_TARGET = "CASE WHEN lang = 'fr' THEN replace(coalesce(text, ''), 'e', 'a') WHEN source = 'src7' THEN coalesce(text, '') || '!' ELSE coalesce(text, '') END"
_MARK = f"'{STAMP}' || strlen(coalesce(text, ''))"


def _sql(folder: str, text: str, more: str = "") -> str:
    return f"SELECT lang || '/' || {folder} || '/doc-' || doc_id || '.txt' AS path, strlen({text}) AS length, {_HASH.format(text)} AS hash, {_MARK} AS fingerprint FROM documents {more}"


SQL = f"""
s AS ({_sql('source', "coalesce(text, '')")}),
t AS ({_sql("CASE WHEN lang = 'de' THEN 'old-' || source ELSE source END", _TARGET)}),
p AS ({_sql('source', _TARGET, "WHERE lang <> 'es'")}),
h AS (SELECT '20260818T100000Z' || CASE WHEN lang = 'en' THEN '' ELSE '-1' END || '/' || lang || '/' || source || '/doc-' || doc_id || '.txt' AS relative_path,
  {_HASH.format("coalesce(text, '')")} AS content_hash, strlen(coalesce(text, '')) AS content_length FROM documents),
c AS (SELECT coalesce(s.path, t.path) AS path, s.path IS NOT NULL AS in_s, t.path IS NOT NULL AS in_t, s.length AS s_length, t.length AS t_length, p.length AS p_length,
  s.hash AS s_hash, t.hash AS t_hash, p.hash AS p_hash, s.fingerprint AS s_fingerprint, p.fingerprint AS p_fingerprint
  FROM s FULL OUTER JOIN t ON s.path = t.path LEFT JOIN p ON p.path = coalesce(s.path, t.path)),
q AS (SELECT *, CASE WHEN NOT in_t THEN 'new' WHEN NOT in_s THEN 'extra' WHEN coalesce(s_length, p_length) <> t_length THEN 'changed'
    WHEN coalesce(s_fingerprint = p_fingerprint AND t_length = coalesce(s_length, p_length) AND t_hash = p_hash, false) THEN 'unchanged'
    WHEN s_hash = t_hash THEN 'unchanged' ELSE 'changed' END AS status,
  CASE WHEN NOT (in_s AND in_t) THEN NULL WHEN coalesce(s_length, p_length) <> t_length THEN 'length'
    WHEN coalesce(s_fingerprint = p_fingerprint AND t_length = coalesce(s_length, p_length) AND t_hash = p_hash, false) THEN 'metadata' ELSE 'content' END AS evidence FROM c)
"""
