"""The registered queries of this package: one per operator, over its whole
table and with production parameters, and the DuckDB SQL where SQL can
express the operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from basketry.llm import chat, decontam, html_text, lexical, line_dedup, mixing, pii, simhash, spelling, token_count, topk, toxicity, url_filter

#: The vocabulary file of the token counts, as named by the tokenizer package.
VOCABULARY = "byte_bpe_50k.json"
TOKEN_LIMIT = 1024
TOP = 10


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find_spans(_table(spark, sf_dir, "documents")))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), short_items=True)


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), simhash.hex_of(F.col("fp")).alias("fingerprint"), F.col("component").alias("component_id"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, _table(spark, sf_dir, "labels")))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_count.count_tokens(_table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), limit=TOKEN_LIMIT)


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(_table(spark, sf_dir, "pages"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = url_filter.train(url_filter.default_labels(spark))
    return url_filter.judge(_table(spark, sf_dir, "pages"), model)


def op9_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, TOP)


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(_table(spark, sf_dir, "conversations"))


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return lexical.search(lexical.build_index(docs), docs, _table(spark, sf_dir, "benchmark")).select("item_id", "rank", "doc_id", "score")


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.dedup_lines(_table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(_table(spark, sf_dir, "documents"))


def queries() -> dict:
    return {f.__name__: f for f in (op1_pii, op2_decontamination, op3_simhash, op4_toxicity, op5_token_counts, op6_html_text,
                                    op7_mixing, op8_url_filter, op9_top_k, op10_chat, op11_lexical_search, op12_line_dedup, op13_spelling_variants)}


def oracle_sql() -> dict[str, str]:
    return {"op1_pii": pii.oracle_sql(), "op9_top_k": topk.ORACLE_SQL, "op10_chat": chat.ORACLE_SQL,
            "op11_lexical_search": lexical.ORACLE_SQL, "op12_line_dedup": line_dedup.ORACLE_SQL}
