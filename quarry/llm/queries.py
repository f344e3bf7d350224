"""Registered queries of the training-data operators, one per operator.

Every query reads its whole table and derives its columns from the operator's
own output.
"""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import adaptive_rules, bagminhash, block_max_search, bpe_automaton, consistent_parse, decontaminate, fasttext, hard_negatives, hash_tree, host_boilerplate, lm_score, oracle, suffix_dedup, toxicity
from .shared import with_package

#: The published tokenizer of op2 and of the pipeline.
TOKENIZER = "word_bpe_49k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    """Place of a published tokenizer file; QUARRY_TOKENIZERS overrides its folder."""
    folder = os.environ.get("QUARRY_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers
    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return with_package(spark).read.parquet(f"{sf_dir}/{name}.parquet")


#: Labelled rows of each class that a classifier is fitted on, at most.
FIT_ROWS = 1000


def _remainder(modulus: int) -> Column:
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(modulus))


def _scored(df: DataFrame, held_out: Column, threshold: float, *more: Column) -> DataFrame:
    return df.select("doc_id", held_out.alias("held_out"), "score",
                     (F.col("score") >= threshold).cast("int").alias("predicted"), *more)


def quality_model(spark: SparkSession, sf_dir: str) -> fasttext.QualityModel:
    """Fitted on labelled documents whose crc32(doc_id) mod 3 is not 1."""
    texts, labels = fasttext.labelled_sample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"),
                                             "quality", _remainder(3) != 1, FIT_ROWS)
    return fasttext.train(texts, labels)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probability that a document is of good quality."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = fasttext.score_texts(docs, quality_model(spark, sf_dir))
    return _scored(scored, F.coalesce(_remainder(3) == 1, F.lit(False)), 0.5)


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and checksums of token ids and of the decoded text."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe_automaton.digest(docs, tokenizer_path()).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of each document that repeat a 100-byte string from earlier on."""
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))


def op4_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cross-entropy difference of each document; the target is all text labelled of good quality."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    good = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return lm_score.score_documents(docs, good).select("doc_id", *[f.name for f in lm_score.FIELDS])


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probability that a document is toxic, and how many of its sentences are."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    marked = table(spark, sf_dir, "labels")
    texts, labels = fasttext.labelled_sample(docs, marked, "toxic", _remainder(4) != 2, FIT_ROWS)
    weight = fasttext.sample_weight(marked, "toxic", _remainder(4) != 2, labels)
    scored = toxicity.score_texts(docs, toxicity.train(texts, labels, clean_weight=weight), locate=True)
    return _scored(scored, F.coalesce(_remainder(4) == 2, F.lit(False)), 0.3,
                   F.size("offending").cast("long").alias("n_offending"))


def op6_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of each document and the verdict of the adaptive thresholds."""
    judged = adaptive_rules.judge(table(spark, sf_dir, "documents"))
    return judged.withColumn("reasons", F.array_join("reasons", ","))


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate class of each document: the least doc_id of its group."""
    return bagminhash.near_duplicates(table(spark, sf_dir, "documents"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of each document inside benchmark windows, and the items they come from."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.find_leaks(docs, table(spark, sf_dir, "benchmark"))
    hit = decontaminate.hit_count(F.col("hit_ranges"))
    return found.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
                        (hit > 0).alias("contaminated"))


def op9_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of each page."""
    found = host_boilerplate.extract_pages(table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "n_dropped")


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """16 shards in 2 regions of 2 racks of 4; a 17th shard comes as a region of its own."""
    tree = hash_tree.HashTree.regular(2, 2, 4)
    placed = hash_tree.shard_documents(table(spark, sf_dir, "documents"), tree, tree.with_region((1.0,)))
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every 50th vector; every 7th vector counts under the next label."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(rows.withColumn("label", moved), anchor=F.col("vec_id") % 50 == 0)


def op12_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of each document and of its edited text, and their likeness."""
    return consistent_parse.against_next(table(spark, sf_dir, "documents"))


def op13_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best documents of each benchmark item."""
    index = block_max_search.build_index(table(spark, sf_dir, "documents"))
    return block_max_search.search(index, table(spark, sf_dir, "benchmark"), k=20)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality": op1_quality,
        "op2_bpe": op2_bpe,
        "op3_suffix_dedup": op3_suffix_dedup,
        "op4_lm_score": op4_lm_score,
        "op5_toxicity": op5_toxicity,
        "op6_rules": op6_rules,
        "op7_near_dedup": op7_near_dedup,
        "op8_decontamination": op8_decontamination,
        "op9_extraction": op9_extraction,
        "op10_sharding": op10_sharding,
        "op11_hard_negatives": op11_hard_negatives,
        "op12_fingerprints": op12_fingerprints,
        "op13_search": op13_search,
    }


def oracle_sql() -> dict[str, str]:
    return oracle.all_sql()
