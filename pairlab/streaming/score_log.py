"""Incremental score collection with Structured Streaming (I5 as a stream, E11).

Score shards land in a directory over time (a scoring job that is resumed,
re-run or extended).  ``start_score_log`` watches the directory with the file
source and, per micro-batch, parses the new files with the tolerant reader
and appends their valid rows — tagged with the batch id — to a Parquet score
log.  ``latest_scores`` reads the log and keeps the last row per
``global_idx`` (later batch, then later file, then later line), which is the
upsert of the batch jobs expressed as an append-only log plus a grouped
read.  The streaming checkpoint tracks which files each batch took, and a
batch writes only its own ``batch_id`` partition, so a retried batch replaces
its earlier attempt instead of duplicating it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.merge import latest_by_index, valid_scores
from ..sources.scores import read_scores_tolerant


def _append_batch(log_path: str):
    def run(batch: DataFrame, batch_id: int) -> None:
        # One row per new file (metadata only); at most maxFilesPerTrigger.
        files = [r.path for r in batch.select("path").orderBy("path").collect()]
        if not files:
            return
        spark = batch.sparkSession
        parsed = valid_scores(read_scores_tolerant(spark, files))
        # A retried batch rewrites only its own partition: idempotent.
        (parsed.withColumn("batch_id", F.lit(batch_id).cast("long"))
         .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("batch_id").parquet(log_path))
    return run


def start_score_log(spark: SparkSession, shard_dir: str, log_path: str, checkpoint: str,
                    max_files_per_trigger: int = 64, glob: str = "*.tmp",
                    available_now: bool = False) -> StreamingQuery:
    """Watch ``shard_dir`` for score files and append parsed rows to ``log_path``."""
    # binaryFile with only ``path`` selected lists new files without reading
    # them; the batch function then scans exactly those files once.
    stream = (spark.readStream.format("binaryFile")
              .schema("path string, modificationTime timestamp, length long, content binary")
              .option("maxFilesPerTrigger", max_files_per_trigger)
              .option("pathGlobFilter", glob)
              .load(shard_dir)
              .select("path"))
    writer = stream.writeStream.foreachBatch(_append_batch(log_path)) \
        .option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")
    return writer.start()


def latest_scores(spark: SparkSession, log_path: str) -> DataFrame:
    """Current scores: last row per ``global_idx`` across all batches."""
    log = spark.read.parquet(log_path)
    return latest_by_index(log, order=("batch_id", "file_ord", "line_idx"),
                           payload=("probs", "output_text", "weighted_score"))
