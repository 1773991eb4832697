"""The operators of this folder as queries over whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reqsieve.llm import chat_tree, decontaminate, forced_bpe, neardup, quality, sharding, simhash, spelling, suffix_tree, token_counts, topk, url_lists, whitening
from reqsieve.session import prepare

Query = Callable[[SparkSession, str], DataFrame]

TOP_K, QUERY_EVERY, SCALE = 5, 50, 256
SHARDS = 40
TOKEN_LIMIT = 4096
#: 2024-01-01, and the two years over which captures and list changes are spread.
FIRST_DAY, SPREAD_SECONDS = 1_704_067_200, 730 * 86_400


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{folder}/{name}.parquet")


def id_remainder(divisor: int, id: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo ``divisor``; null for a null id."""
    return F.crc32(F.col(id).cast("string").cast("binary")) % divisor


def op1_threshold_topk(spark: SparkSession, folder: str) -> DataFrame:
    return topk.top_k(_table(spark, folder, "embeddings"), F.col("vec_id") % QUERY_EVERY == 0, TOP_K, scale=SCALE)


def op2_jump_hash_shards(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents").select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long").alias("size"),
        F.crc32(F.col("text").cast("binary")).alias("text_crc32"),
    )
    placed = sharding.assign_shards(docs, "doc_id", SHARDS, ["doc_id", "text_crc32", "size"])
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op3_suffix_tree_scores(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    # a row without an id has no remainder of 2, so it is learned from
    return suffix_tree.score_texts(docs, F.coalesce(id_remainder(7) != 2, F.lit(True)))


#: Says nothing but control strings.
CONTROL_TEXT = "<|im_end|><|im_start|>assistant ok"


def op4_chat_prefix_tree(spark: SparkSession, folder: str) -> DataFrame:
    rows = _table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    extra = [(-1, k, role, CONTROL_TEXT) for k, role in enumerate(("user", "assistant"))]
    return chat_tree.format_conversations(rows.unionByName(spark.createDataFrame(extra, rows.schema)))


def op5_suffix_array_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    found = decontaminate.find_matches(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"), ["doc_id"])
    items = F.array_sort(F.array_distinct(F.transform("matches", lambda m: m["item_id"].cast("string"))))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op6_whole_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    path = public_tokenizers.path("piece_bpe_32k.model")
    counted = token_counts.count_tokens(_table(spark, folder, "documents"), path, ["doc_id"])
    return counted.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


def quality_model(spark: SparkSession, folder: str, docs: DataFrame) -> Broadcast:
    """Learned from the labels of rows whose id has a remainder other than 0."""
    labels = _table(spark, folder, "labels")
    good = labels.filter((F.col("quality") == 1) & (id_remainder(5) != 0))
    return spark.sparkContext.broadcast(quality.train(docs, good))


def op7_positive_unlabelled_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    scored = quality.score_texts(docs, quality_model(spark, folder, docs), ["doc_id"])
    held_out = F.coalesce(id_remainder(5) == 0, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"))


def op8_weighted_minhash(spark: SparkSession, folder: str) -> DataFrame:
    classes = neardup.text_classes(_table(spark, folder, "documents"))
    return classes.select("doc_id", "class_id", "class_size", "stays")


def op9_forced_boundary_bpe(spark: SparkSession, folder: str) -> DataFrame:
    path = public_tokenizers.path("word_bpe_49k.json")
    docs = _table(spark, folder, "documents")
    return forced_bpe.encode_decode(docs, path, ["doc_id"], outputs=("ids_sha256", "decoded_sha256"))


def page_captures(spark: SparkSession, folder: str) -> DataFrame:
    """Pages with a fetch time that follows from their id."""
    second = F.lit(FIRST_DAY) + F.pmod(F.col("page_id") * 7919, F.lit(SPREAD_SECONDS))
    return _table(spark, folder, "pages").select("page_id", "url", F.timestamp_seconds(second).alias("fetched_at"))


def list_changes(spark: SparkSession, folder: str) -> DataFrame:
    """A log of dated list changes for the hosts of the pages, their domains and folders.

    Each host enters a list, leaves it and enters it again; its ``/en`` folder enters
    another one, on every second host for good; its parent domain enters a third for some weeks.
    """
    pages = _table(spark, folder, "pages").withColumn("host", url_lists.url_host(F.col("url"))).filter("host <> ''")
    hosts = pages.groupBy("host").agg(F.min("page_id").alias("m"))
    parent = F.regexp_replace("host", r"^[^.]*\.", "")
    kinds = F.element_at(F.array(*map(F.lit, ("ads", "malware", "adult"))), (F.col("m") % 3 + 1).cast("int"))

    def change(name: Column, pattern: Column, action: str, day: Column) -> Column:
        at = F.timestamp_seconds(F.lit(FIRST_DAY) + day.cast("long") * 86_400)
        return F.struct(name.alias("list"), pattern.alias("pattern"), F.lit(action).alias("action"), at.alias("at"))

    m, host = F.col("m"), F.col("host")
    start, folder_start = m * 37 % 400, m * 53 % 500
    changes = F.array(
        change(kinds, host, "add", start),
        change(kinds, host, "remove", start + 30 + m % 90),
        change(kinds, host, "add", start + 200),
        change(F.lit("folder"), F.concat(host, F.lit("/en")), "add", folder_start),
        change(F.lit("folder"), F.concat(host, F.lit("/en")), "remove", F.when(m % 2 == 1, folder_start + 100)),
        change(F.lit("registrar"), parent, "add", m * 11 % 700),
        change(F.lit("registrar"), parent, "remove", m * 11 % 700 + 20),
    )
    return hosts.select(F.inline(changes))


def op10_temporal_url_lists(spark: SparkSession, folder: str) -> DataFrame:
    judged = url_lists.filter_urls(page_captures(spark, folder), list_changes(spark, folder), "page_id")
    return judged.select(
        "page_id", F.col("fetched_at").cast("timestamp_ntz").alias("fetched_at"), F.array_join("lists", ",").alias("lists"), "n_entries", "blocked"
    )


def op11_embedding_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whitening.whiten(_table(spark, folder, "embeddings"), scale=SCALE)


def op12_spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    return spelling.spelling_forms(_table(spark, folder, "documents"))


def op13_simhash_components(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.simhash_components(_table(spark, folder, "documents"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_threshold_topk,
        op2_jump_hash_shards,
        op3_suffix_tree_scores,
        op4_chat_prefix_tree,
        op5_suffix_array_decontamination,
        op6_whole_token_counts,
        op7_positive_unlabelled_quality,
        op8_weighted_minhash,
        op9_forced_boundary_bpe,
        op10_temporal_url_lists,
        op11_embedding_whitening,
        op12_spelling_variants,
        op13_simhash_components,
    )
}
