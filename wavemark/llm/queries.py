"""The registered queries of the text operators: each runs over its whole tables.

QUERIES maps a name to a function of (spark, sf_dir); SQL holds DuckDB's form where SQL can say it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import chaining, decontaminate, jaccard, kneser_ney, language, mixing, negatives, rules, sharding, tokens, toxicity, trie, urls
from .common import table


def op2_hilbert_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))


def op3_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxic_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_kneser_ney_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kneser_ney.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op1_bm25_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return language.identify(table(spark, sf_dir, "documents"), language.LanguageConfig(public_tokenizers.path("piece_bpe_32k.model")))


def op6_collinear_chaining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chaining.repeated_passages(table(spark, sf_dir, "documents"))


def op7_pareto_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op8_risk_controlled_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("lang")


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    cfg = tokens.TokenFileConfig(public_tokenizers.path("byte_bpe_50k.json"))
    return tokens.round_trip(table(spark, sf_dir, "documents"), cfg).drop("file")


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents"), jaccard.JaccardConfig(width=4, least=85))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negatives.hard_negatives(table(spark, sf_dir, "embeddings"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.rebuilt_trie(table(spark, sf_dir, "conversations")).drop("preorder", "subtree_end")


def op13_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"), urls.rule_table(spark))


QUERIES = {f.__name__: f for f in (op1_bm25_decontamination, op2_hilbert_sharding, op3_toxicity_chain, op4_kneser_ney_quality, op5_language_id, op6_collinear_chaining, op7_pareto_mixing, op8_risk_controlled_rules, op9_token_files, op10_ngram_jaccard_join, op11_hard_negatives, op12_prefix_trie, op13_url_filters)}

SQL: dict[str, str] = {
    "op7_pareto_mixing": mixing.SQL,
    "op8_risk_controlled_rules": rules.SQL,
    "op11_hard_negatives": negatives.SQL,
    "op12_prefix_trie": trie.SQL,
    "op13_url_filters": urls.SQL,
    "op10_ngram_jaccard_join": r"""
        WITH RECURSIVE w AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
            FROM documents
        ), s AS (
            SELECT DISTINCT doc_id, unnest(CASE
                WHEN len(ws) >= 4 THEN list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' '))
                WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS g
            FROM w
        ), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id), links AS (
            SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM s x JOIN s y USING (g) WHERE x.doc_id <> y.doc_id GROUP BY ALL)
            JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b
            WHERE 100 * shared >= 85 * (na.n + nb.n - shared)
        ), reach AS (
            SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b
        ), low AS (SELECT a, min(b) AS b FROM reach GROUP BY a)
        SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, least(w.doc_id, coalesce(low.b, w.doc_id)) AS component_id
        FROM w LEFT JOIN n USING (doc_id) LEFT JOIN low ON low.a = w.doc_id
    """,
}
