"""Submissions, job states, results and running scores as streams.

Every job writes what a batch produces under the batch's own folder, so a
repeated batch after a failure replaces itself.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.responses import parse_response
from ..operators.jobs import latest_state
from ..operators.normalize import remap_serving
from ..operators.predict import LOAD_FAILED, Runner, predict
from ..operators.validate import outcome, violations

RESULT_LIFE = "24 hours"
_LISTING_TASKS = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
KEPT_LISTED = 200_000  # files of one listing that later batches take without another
FILE_COLUMNS = "path string, modificationTime timestamp, length bigint, content binary"


def submissions(spark: SparkSession, path: str, files_per_trigger: int = 1000) -> DataFrame:
    """One row per new image file: ``job_id, path, content_type, content``."""
    files = (
        spark.readStream.format("binaryFile")
        .schema(FILE_COLUMNS)
        .option("recursiveFileLookup", "true")
        .option("maxFilesPerTrigger", files_per_trigger)
        .option("maxCachedFiles", KEPT_LISTED)
        .load(path)
    )
    extension = F.lower(F.substring_index("path", ".", -1))
    kind = F.when(extension.isin("jpg", "jpeg"), "image/jpeg").when(
        extension.isin("png", "webp"), F.concat(F.lit("image/"), extension)
    )
    job = F.md5(F.concat("path", F.col("modificationTime").cast("string")).cast("binary"))
    return files.select(
        job.alias("job_id"),
        "path",
        F.coalesce(kind, F.lit("application/octet-stream")).alias("content_type"),
        "content",
    )


def extract(
    submitted: DataFrame, model_id: str, factory: Callable[[], Runner], attempts: int = 4
) -> DataFrame:
    """R1 for one batch: predict, parse, remap, validate; one row per job with its status code.

    Submissions that are no image never reach the model.
    """
    is_image = F.coalesce(F.col("content_type").startswith("image/"), F.lit(False))
    rejected = submitted.filter(~is_image).select(
        "job_id", "content_type", F.lit(None).cast("string").alias("raw"), F.lit(None).cast("string").alias("error")
    )
    answered = predict(
        submitted.filter(is_image).select("job_id", "content_type", "content"),
        model_id,
        factory,
        attempts=attempts,
    ).select("job_id", "content_type", "raw", "error")
    parsed = answered.unionByName(rejected).withColumn("_r", parse_response(F.col("raw")))
    bad = F.when(
        F.col("error").isNull() & (F.col("_r.status") != "ok"), F.lit("response is not a JSON object")
    )
    mapped = remap_serving(
        parsed.withColumn("error", F.coalesce("error", bad)).withColumn("payload", F.col("_r.payload"))
    ).withColumn("json", F.to_json("receipt"))
    checked = violations(mapped, name="problems")
    loaded = ~F.coalesce(F.col("error").startswith(LOAD_FAILED), F.lit(False))
    code = outcome(F.col("content_type"), loaded, F.col("error"), F.col("problems"))
    return checked.select("job_id", code.alias("status_code"), "error", "problems", "json")


def start_extraction(
    submitted: DataFrame, model_id: str, factory: Callable[[], Runner], out: str, checkpoint: str
):
    """Valid receipts to ``out/valid``, all others with their reason to ``out/quarantine``."""

    def write(batch: DataFrame, batch_id: int) -> None:
        done = extract(batch, model_id, factory).withColumn("valid", F.col("status_code") == 200)
        done.write.mode("overwrite").partitionBy("valid").parquet(f"{out}/batch={batch_id}")

    return (
        submitted.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def extraction_results(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.option("basePath", out).parquet(f"{out}/batch=*")


def start_job_states(events: DataFrame, out: str, checkpoint: str):
    """R2: changed jobs of every batch; ``current_states`` keeps the last per job."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return (
        latest_state(events)
        .writeStream.outputMode("update")
        .foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def current_states(spark: SparkSession, out: str) -> DataFrame:
    changes = spark.read.option("basePath", out).parquet(f"{out}/batch=*")
    last = F.max_by(F.struct("status", "result"), "batch").alias("_l")
    return changes.groupBy("job_id").agg(last).select("job_id", "_l.*")


def dedupe_results(results: DataFrame) -> DataFrame:
    """The first delivery of each task within the result life; state is dropped after it.

    Input should arrive about in time order: a row later than the watermark is
    dropped here, and the count of such rows shows in the query progress;
    ``start_settling`` takes deliveries in any order.
    """
    return results.withWatermark("ts", RESULT_LIFE).dropDuplicatesWithinWatermark(["task_id"])


def start_settling(results: DataFrame, out: str, checkpoint: str, buckets: int = 64):
    """R3 in any order of time: each task's first delivery goes to a table of settled tasks, dealt by hash of the task.

    A batch reads the buckets that its own tasks fall into, once each, and leaves
    out what is settled there; other buckets and earlier deliveries are not read. A
    repeated batch ignores and replaces what it wrote itself.
    """
    bucket = F.pmod(F.xxhash64("task_id"), F.lit(buckets)).cast("int")

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        first = batch.groupBy("task_id").agg(F.min("ts").alias("ts")).withColumn("bucket", bucket)
        touched = sorted(r.bucket for r in first.select("bucket").distinct().collect())  # at most ``buckets``
        path = spark._jvm.org.apache.hadoop.fs.Path
        files = path(out).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        known = [p for p in (f"{out}/bucket={b}" for b in touched) if files.exists(path(p))]
        if known:
            settled = spark.read.schema(settled_schema(first)).option("basePath", out).parquet(*known)
            first = first.join(settled.filter(F.col("batch") != batch_id).select("task_id"), "task_id", "left_anti")
        rows = first.withColumn("batch", F.lit(batch_id).cast("bigint")).repartition("bucket")
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "batch").parquet(out)

    return (
        results.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def settled_schema(first: DataFrame) -> str:
    """Columns of the table of settled tasks."""
    return f"task_id {first.schema['task_id'].dataType.simpleString()}, ts timestamp, bucket int, batch bigint"


@contextmanager
def few_listing_tasks(spark: SparkSession) -> Iterator[None]:
    """For as long as a stream of files runs: a batch looks its files up again, by default in a task each."""
    before = spark.conf.get(_LISTING_TASKS)
    spark.conf.set(_LISTING_TASKS, 4 * spark.sparkContext.defaultParallelism)
    try:
        yield
    finally:
        spark.conf.set(_LISTING_TASKS, before)


def start_append(stream: DataFrame, out: str, checkpoint: str):
    return (
        stream.writeStream.format("parquet")
        .outputMode("append")
        .option("path", out)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def start_running_means(scored: DataFrame, out: str, checkpoint: str):
    """Count and mean overall F1 per model after every batch (one row per model)."""
    running = scored.groupBy("model_id").agg(
        F.count("*").alias("n"), F.avg("overall_f1").alias("mean_f1")
    )

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return (
        running.writeStream.outputMode("complete")
        .foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def last_means(spark: SparkSession, out: str) -> DataFrame:
    log = spark.read.option("basePath", out).parquet(f"{out}/batch=*")
    return log.groupBy("model_id").agg(
        F.max_by(F.struct("n", "mean_f1"), "batch").alias("_l")
    ).select("model_id", "_l.*")
