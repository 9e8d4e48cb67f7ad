"""The registered queries of this package: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from datamove.llm import (best_fit, divergence, embedding_dedup, fingerprints, hmm, language_id, ngram_join, packing, sharding, toxicity, trie_bpe, url_rules,
                          whitening)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql.strip()
        return fn
    return register


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{table}.parquet")


@query("op1_fingerprints")
def op1_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return fingerprints.fingerprint_documents(read(spark, folder, "documents"))


@query("op2_trie_bpe")
def op2_trie_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return trie_bpe.encode_documents(read(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query("op3_url_rules")
def op3_url_rules(spark: SparkSession, folder: str) -> DataFrame:
    return url_rules.filter_urls(read(spark, folder, "pages"), read(spark, folder, "labels"))


@query("op4_ngram_join")
def op4_ngram_join(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_join.ngram_groups(read(spark, folder, "documents"), width=3, percent=90)


@query("op5_embedding_dedup")
def op5_embedding_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return embedding_dedup.near_duplicates(read(spark, folder, "embeddings"))


@query("op6_hmm")
def op6_hmm(spark: SparkSession, folder: str) -> DataFrame:
    return hmm.score_documents(read(spark, folder, "documents"))


@query("op7_language_id")
def op7_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents")
    found = language_id.predict_documents(docs, language_id.fit(docs))
    return found.select("doc_id", (toxicity.fold("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score")


@query("op8_toxicity")
def op8_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents")
    found = toxicity.score_documents(docs, toxicity.fit(docs, read(spark, folder, "labels")))
    return found.select("doc_id", (toxicity.fold("doc_id", 5) == 0).alias("held_out"), "score", "predicted")


@query("op9_sharding")
def op9_sharding(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.interleave(read(spark, folder, "documents"))


@query("op10_packing")
def op10_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(read(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query("op11_best_fit")
def op11_best_fit(spark: SparkSession, folder: str) -> DataFrame:
    return best_fit.pack_best_fit(read(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query("op12_divergence", """
WITH docs AS (SELECT row_number() OVER () AS d, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
words AS (SELECT d, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs),
counted AS (SELECT lang, source, term, count(*) AS c FROM words GROUP BY ALL),
kept AS (SELECT lang, term, count(*) AS lang_c FROM words GROUP BY ALL HAVING count(DISTINCT d) >= 30),
langs AS (SELECT lang, count(*) AS v, sum(lang_c) AS n FROM kept GROUP BY lang),
grouped AS (SELECT g.lang, g.source, coalesce(sum(c), 0) AS n FROM (SELECT DISTINCT lang, source FROM docs) g
  LEFT JOIN (SELECT counted.* FROM counted JOIN kept USING (lang, term)) k ON k.lang = g.lang AND k.source = g.source GROUP BY ALL),
priced AS (SELECT g.lang, g.source, k.term, coalesce(c.c, 0) AS c,
    1 + (1000000000::HUGEINT * (coalesce(c.c, 0) + 5)) // (g.n + 5 * l.v)::HUGEINT AS p,
    1 + (1000000000::HUGEINT * (k.lang_c + 5)) // (l.n + 5 * l.v)::HUGEINT AS q
  FROM grouped g JOIN kept k ON k.lang = g.lang JOIN langs l ON l.lang = g.lang
  LEFT JOIN counted c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
sums AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM priced a
  JOIN priced b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(s.value, 0)::BIGINT AS value FROM grouped a
  JOIN grouped b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source)
SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INT AS rank FROM pairs
UNION ALL
SELECT lang, source, 'term' AS part, term AS item, (p - q)::BIGINT AS value,
  row_number() OVER (PARTITION BY lang, source ORDER BY p - q DESC, term)::INT AS rank
FROM priced WHERE c > 0 AND p > q QUALIFY row_number() OVER (PARTITION BY lang, source ORDER BY p - q DESC, term) <= 50
""")
def op12_divergence(spark: SparkSession, folder: str) -> DataFrame:
    return divergence.audit(read(spark, folder, "documents"))


@query("op13_whitening")
def op13_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whitening.whiten(read(spark, folder, "embeddings"))
