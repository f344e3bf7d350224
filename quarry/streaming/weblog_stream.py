"""Requests per host class (C1) over a growing folder of access-log files.

The parsing and classification are stateless column expressions, so the same
functions run unchanged on a streaming DataFrame; the per-class count is one
streaming aggregation whose state is bounded by the number of classes. Each
micro-batch replaces a result table (complete mode through ``foreachBatch``),
so nothing is collected on the driver, and the checkpoint location makes the
query restartable after a failure.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quarry.functions.classify import ACADEMIC_SUFFIXES
from quarry.functions.logparse import parse_log
from quarry.plans.weblog import CLASS, classify_hosts


def class_counts_stream(lines: DataFrame, rules=ACADEMIC_SUFFIXES) -> DataFrame:
    """Streaming (or batch) requests per host class."""
    classified = classify_hosts(parse_log(lines), rules)
    return classified.groupBy(CLASS).agg(F.count(F.lit(1)).alias("count"))


def start_class_counts(spark: SparkSession, source_dir: str, result_path: str, checkpoint_location: str,
                       rules=ACADEMIC_SUFFIXES, available_now: bool = True,
                       max_files_per_trigger: int | None = None) -> StreamingQuery:
    """Start the streaming count over text files in ``source_dir``.

    ``available_now`` processes what is there (in bounded micro-batches) and
    stops, which suits scheduled runs; otherwise the query keeps running.
    """
    reader = spark.readStream.format("text")
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    counts = class_counts_stream(reader.load(source_dir), rules)

    def replace_result(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(result_path)

    writer = (counts.writeStream.outputMode("complete")
                    .option("checkpointLocation", checkpoint_location)
                    .foreachBatch(replace_result))
    writer = writer.trigger(availableNow=True) if available_now else writer
    return writer.start()
