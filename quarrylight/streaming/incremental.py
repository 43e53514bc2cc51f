"""Structured Streaming: documents that keep arriving to chunks of an index, and windows over events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylight.operators.chunking import word_chunks
from quarrylight.scratch import scratch_dir


def index_stream(stream: DataFrame, path: str, checkpoint: str, size: int = 800, overlap: int = 100):
    """Chunks of new texts (doc_id, text, loaded_at) appended to ``path``, each text once; runs until what is there is done.

    A text that comes again within the watermark of 30 days is dropped by its hash; the checkpoint makes a restart go on.
    """
    once = stream.withColumn("loaded_at", F.col("loaded_at").cast("timestamp")).withColumn("sha", F.sha2(F.coalesce("text", F.lit("")), 256)).withWatermark("loaded_at", "30 days").dropDuplicatesWithinWatermark(["sha"])
    chunks = word_chunks(once, "text", size, overlap).drop("text")
    return chunks.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def event_windows(stream: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Events and their values per kind and window; later ones than the watermark are dropped."""
    stream = stream.withColumn("ts", F.col("ts").cast("timestamp"))  # a watermark needs an instant
    return stream.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 6).alias("total"))


def run_windows(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """``event_windows`` over a file stream, completed, as a table; windows still open at the end of the stream are in it.

    Each batch writes the windows that it changed, and the last state of each window counts.
    """
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(folder)
    out = scratch_dir(spark)

    def keep(changed: DataFrame, batch: int) -> None:
        changed.write.mode("overwrite").parquet(f"{out}/data/batch={batch}")

    q = event_windows(stream).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    states = spark.read.schema("w struct<start:timestamp,end:timestamp>, event_type string, n bigint, total double, batch bigint").parquet(f"{out}/data")
    return states.groupBy("w", "event_type").agg(F.max_by(F.struct("n", "total"), "batch").alias("x")).select("w", "event_type", "x.n", "x.total")
