"""One query per operator, over its whole tables, with the SQL oracles where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.llm import bpe_backtrack, conversation_repair, embedding_ego, exact_dedup, jaccard_join, lang_profiles, line_dedup, maxscore, periodic_runs, secret_ownership, source_mix, url_cascade, warc_derive

QUERIES = {}
ORACLE: dict[str, str] = {}
#: The rank file of op7; a path that every executor has.
RANK_FILE = "byte_bpe_multi_50k.tiktoken"


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op2_bloom_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_cascade.judge(table(spark, sf_dir, "pages"), url_cascade.junk_page())


ORACLE["op2_bloom_cascade"] = url_cascade.ORACLE


@query
def op3_secret_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    owner = F.col("source")
    repository = F.concat_ws("/", "source", "lang")
    return secret_ownership.digest(secret_ownership.scan(table(spark, sf_dir, "documents"), owner, repository))


@query
def op4_rank_order_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    named = lang_profiles.identify(docs.select("doc_id", "text"), lang_profiles.fit(docs))
    return named.select("doc_id", (~lang_profiles.fit_split()).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))


@query
def op7_bpe_backtracking(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe_backtrack.digests(bpe_backtrack.encode(docs, public_tokenizers.path(RANK_FILE), public_tokenizers.PATTERN).drop("text"))


@query
def op8_hash_threshold_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = source_mix.mix(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return mixed.select("doc_id", F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"),
                        F.col("mix_target").alias("target"), F.col("mix_taken").alias("taken"))


ORACLE["op8_hash_threshold_mix"] = source_mix.ORACLE


@query
def op9_epsilon_grid_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_ego.link(table(spark, sf_dir, "embeddings"))


@query
def op10_maxscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxscore.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


ORACLE["op10_maxscore"] = maxscore.ORACLE


@query
def op5_bayesian_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.public(jaccard_join.join(table(spark, sf_dir, "documents")))


@query
def op6_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    deduped = line_dedup.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"), count_as="lines_removed", cuts=True)
    return deduped.select("doc_id", F.length("text").alias("chars_kept"), F.md5("text").alias("text_md5"), "lines_removed", "text")


@query
def op1_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = warc_derive.page_responses(table(spark, sf_dir, "pages"))
    return warc_derive.derive(pages, keep="page_id", record_id=F.col("record_id"), target=F.col("target"), date=F.col("date"),
                              http_head=F.col("http_head"), payload=F.col("payload"))


@query
def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup.groups(table(spark, sf_dir, "documents"), keep="largest")
    return found.select("doc_id", F.col("dup_keep_id").alias("keep_id"), F.col("dup_size").alias("group_size"), F.col("dup_kept").alias("kept"),
                        F.col("dup_sha256").alias("text_sha256"))


ORACLE["op11_exact_dedup"] = exact_dedup.ORACLE


@query
def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = periodic_runs.looped(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return periodic_runs.digests(periodic_runs.find(docs))


@query
def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = conversation_repair.damaged(table(spark, sf_dir, "conversations"))
    return conversation_repair.report(conversation_repair.repair(rows, live=F.col("live")))
