"""The corpus pipeline: five stages over ``documents``.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept
and returns a DataFrame; ``run`` writes every result but the last as Parquet
and rereads it as the next stage's docs.  All but the last return the columns
of ``documents``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import bagminhash, bpe_automaton, decontaminate, fasttext, queries, suffix_dedup
from quarry.llm.shared import shared_folder, with_package, written
from quarry.session import let_go


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts (score of at least 0.5)."""
    scored = fasttext.score_texts(docs.withColumnsRenamed({"score": "__score"}), queries.quality_model(spark, sf_dir))
    return (scored.where("score >= 0.5").drop("score").withColumnsRenamed({"__score": "score"})
            .select(*docs.columns))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the least doc_id, of each near-duplicate class."""
    return bagminhash.keep_one(docs).select(*docs.columns)


def suffix_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes of 100-byte strings that start earlier in the corpus.

    Documents of which nothing is left go; ``n_chars`` follows the text.
    """
    # a key of its own for each row, in the order of doc_id: null and repeated doc_ids keep to their own texts
    tied = docs.withColumn("__tie", F.monotonically_increasing_id())
    numbered = written(tied.orderBy(F.col("doc_id").asc_nulls_last(), "text", "__tie").drop("__tie")
                       .withColumn("__row", F.monotonically_increasing_id()))
    let_go(spark)  # the files of the sort
    # the other columns go along with the texts: no second and third copy of all texts is shuffled to join them
    others = F.struct(*[c for c in docs.columns if c != "text"], F.col("text").isNull().alias("__none"))
    cut = suffix_dedup.remove_repeats(numbered, id_col="__row", with_text=True, carried=others)
    changed = F.col("n_removed") > 0
    text = F.when(changed, F.col("kept")).when(~F.col("carried.__none"), F.col("text"))
    cut = cut.select("carried.*", text.alias("text"), changed.alias("__changed"))
    return (cut.withColumn("n_chars", F.when(F.col("__changed"), F.length("text").cast("long")).otherwise(F.col("n_chars")))
            .where(~(F.col("__changed") & (F.length(F.trim("text")) == 0))).select(*docs.columns))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without benchmark spans; documents that such spans cover by more than half go."""
    items = queries.table(spark, sf_dir, "benchmark")
    clean = decontaminate.remove_leaks(docs.withColumn("__before", F.length("text")), items, max_coverage=0.5)
    changed = F.length("text") != F.col("__before")
    return (clean.withColumn("n_chars", F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars")))
            .select(*docs.columns))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, token ids, and the checksum of the text they decode to."""
    texts = docs.select("doc_id", "lang", "source", "text")
    return (bpe_automaton.digest(texts, queries.tokenizer_path(), with_ids=True)
            .select("doc_id", "lang", "source", "ids", "n_tokens", "decoded_sha256"))


STAGES = [
    ("quality classifier", quality),
    ("MinHash near-dedup", near_dedup),
    ("suffix-array dedup", suffix_dedup_stage),
    ("benchmark decontamination", decontamination),
    ("BPE encoding and decoding", tokens),
]

#: Learned scores, signatures and tokens aren't SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents``."""
    with_package(spark)
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs.write.parquet(f"{folder}/{k}")
            docs = spark.read.parquet(f"{folder}/{k}")
    return docs
