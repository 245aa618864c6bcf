"""The queries of the text operators, over the tables of a folder, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tramline.llm import jaccard_join, langid, merkle, minhash_dedup, mixing, oracle, packing, pii, prefix_trie, quality_pu, quality_rules, sharding, structures_sql, suffix_dedup, webp
from tramline.llm.common import table

#: Rows that Arrow hands to Python at once: long texts would make the default's batches large.
ARROW_ROWS = 1024


def arrow(spark: SparkSession) -> SparkSession:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
    return spark


def held_out(key: Column) -> Column:
    return F.crc32(key.cast("string").cast("binary")) % 4 == 2


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(arrow(spark), sf_dir, "documents"))


def op2_webp(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(arrow(spark), sf_dir, "documents")
    n = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    media = webp.with_pixels(webp.with_media(docs.select("doc_id", "text")))
    read = media.select("doc_id", n.alias("n_bytes"), webp.digest_of("media", "pixels", n).alias("d"))
    return read.select("doc_id", "n_bytes", "d.payload_bytes", "d.payload_sha256", "d.tail_crc32", "d.media_bytes", "d.media_sha256", "d.feature")


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(arrow(spark), sf_dir, "documents")
    model = langid.fit(docs.where(~held_out(F.col("doc_id"))))
    found = langid.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))


def op4_quality_pu(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(arrow(spark), sf_dir, "documents").select("doc_id", "text")
    taught = ~held_out(F.col("doc_id"))
    trusted = table(spark, sf_dir, "labels").where(taught & (F.col("quality") == 1))
    scored = quality_pu.score(docs, quality_pu.fit(docs.where(taught), trusted))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(arrow(spark), sf_dir, "documents"), vocabulary())


def op6_rendezvous(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_by_key(table(spark, sf_dir, "documents"))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicates(table(arrow(spark), sf_dir, "documents"))


def op8_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pii.pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "text", F.size("pii_found").cast("long").alias("n_found"), *pii.count_kinds(F.col("pii_found")))


def op9_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.rules(table(spark, sf_dir, "documents"))


def op10_curriculum(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.curriculum(table(spark, sf_dir, "documents"))
    # targets are at most two times a source's size, so there are at most two copies
    first, second = (F.round(F.get("positions", F.lit(i)), 9).alias(n) for i, n in enumerate(("position", "second_position")))
    return out.select("doc_id", "size", "source_size", "target", "taken", "source", first, second)


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(table(arrow(spark), sf_dir, "conversations"))


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(table(arrow(spark), sf_dir, "documents"), seen=merkle.tampered())


def op13_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.mark(table(arrow(spark), sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_suffix_dedup, op2_webp, op3_language, op4_quality_pu, op5_packing, op6_rendezvous, op7_jaccard_join, op8_pseudonyms, op9_divergence, op10_curriculum, op11_prefix_trie, op12_merkle, op13_minhash_dedup)}

ORACLE_SQL: dict[str, str] = oracle.ORACLE_SQL | structures_sql.SQL
