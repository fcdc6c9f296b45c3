"""The registered queries opN_<name> and pipeline, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, audit, bpe, contamination, htmltext, langid, licenses, minhash, negatives, ngram, packing, quality, simhash
from .common import crc_mod, table


def op1_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = quality.scored(docs, *quality.train(docs, table(spark, sf_dir, "labels")))
    return found.withColumn("keep", F.col("p_good") >= quality.KEEP)


def op3_ngram_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rest = crc_mod(F.col("doc_id"), 10)
    model = ngram.train(docs.where(rest != 0))
    found = ngram.scored(docs, model)
    return found.select("doc_id", F.coalesce(rest == 0, F.lit(False)).alias("held_out"), "n_tokens", "n_known", F.lit(model["tokens"]).cast("long").alias("train_tokens"), "base_score", "score")


def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.compared(table(spark, sf_dir, "documents"))


def minhash_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 4's bands, joined and verified: each document's class of texts with a Jaccard similarity of 0.8 or more."""
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return htmltext.extracted(pages, htmltext.learn(pages))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(crc_mod(F.col("doc_id"), 4) == 2, F.lit(False))
    vocabulary = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    langs, logp = langid.train(docs.where(~held_out), vocabulary)
    found = langid.predict(docs, langs, logp, vocabulary)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit(audit.flagged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label, vec_id = F.col("label").cast("bigint"), F.col("vec_id")
    return negatives.mined(table(spark, sf_dir, "embeddings"), vec_id % 50 == 0, F.when(vec_id % 7 == 0, (label + 1) % 10).otherwise(label))


def op13_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination.digest(contamination.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_ann": op1_ann, "op2_quality": op2_quality, "op3_ngram_score": op3_ngram_score, "op4_minhash": op4_minhash, "minhash_classes": minhash_classes, "op5_simhash": op5_simhash, "op6_html_text": op6_html_text, "op7_language_id": op7_language_id, "op8_byte_bpe": op8_byte_bpe, "op9_best_fit_packing": op9_best_fit_packing, "op10_licenses": op10_licenses, "op11_filter_audit": op11_filter_audit, "op12_hard_negatives": op12_hard_negatives, "op13_decontamination": op13_decontamination}


#: Every pair, measured: what the codes must find.
OP1_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
d AS (SELECT q.vec_id AS query_id, c.vec_id, sqrt(list_reduce(list_transform(list_zip(q.e, c.e), lambda p: (p[1] - p[2]) * (p[1] - p[2])), lambda a, b: a + b)) AS score FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS rank FROM d) WHERE rank <= 10"""


def oracle_sql() -> dict[str, str]:
    return {"op1_ann": OP1_SQL, "op10_licenses": licenses.scan_sql(), "op11_filter_audit": audit.AUDIT_SQL, "op12_hard_negatives": negatives.MINED_SQL, "op13_decontamination": contamination.SCAN_SQL}
