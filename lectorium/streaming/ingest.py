"""Documents that keep arriving: cleaned, cut into chunks and upserted batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from lectorium.functions.text import clean_text
from lectorium.operators.chunking import chunk_texts
from lectorium.operators.lexical import word_postings


def read_documents(spark: SparkSession, folder: str, schema: T.StructType, files_per_batch: int = 100) -> DataFrame:
    """Stream of the Parquet files that appear in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def chunks_of(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", size: int = 500, overlap: int = 100) -> DataFrame:
    """(id, file_hash, ingested_at, chunk_order, body, char_count): stateless, so it needs no watermark."""
    rows = documents.where(F.col(text_column).isNotNull()).select(F.col(id_column), F.sha2(text_column, 256).alias("file_hash"), "ingested_at", clean_text(F.col(text_column)).alias("_text"))
    return chunk_texts(rows, "_text", size, overlap)


def deduplicated(documents: DataFrame, time: str = "ingested_at", delay: str = "7 days", text_column: str = "text") -> DataFrame:
    """Documents without later copies of a text within the watermark's delay; state is dropped as the watermark passes."""
    hashed = documents.where(F.col(time).isNotNull()).withColumn("file_hash", F.sha2(F.coalesce(text_column, F.lit("")), 256))
    return hashed.withWatermark(time, delay).dropDuplicatesWithinWatermark(["file_hash"])


def write_chunks(chunks: DataFrame, table_path: str, postings_path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Writes each batch's chunks and word postings under its batch_id, so a repeated batch replaces itself."""

    def save(batch: DataFrame, batch_id: int) -> None:
        kept = batch.persist()
        kept.write.mode("overwrite").parquet(f"{table_path}/batch_id={batch_id}")
        id_column = kept.columns[0]
        numbered = kept.select(F.concat_ws("-", F.col(id_column).cast("string"), F.col("chunk_order").cast("string")).alias("chunk_id"), "body")
        word_postings(numbered, "chunk_id", None, "body").write.mode("overwrite").parquet(f"{postings_path}/batch_id={batch_id}")
        kept.unpersist()

    writer = chunks.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def windowed_counts(events: DataFrame, time: str = "ts", width: str = "1 hour", delay: str = "2 hours", key: str = "event_type") -> DataFrame:
    """Counts and sums of a key in tumbling windows; events later than the watermark's delay are dropped."""
    return events.withWatermark(time, delay).groupBy(F.window(time, width).alias("w"), key).agg(F.count("*").alias("events"), F.sum("value").alias("total")).select(F.col("w.start").alias("window_start"), key, "events", "total")


def sessions(events: DataFrame, time: str = "ts", gap: str = "30 minutes", delay: str = "2 hours", key: str = "user_id") -> DataFrame:
    """Sessions of a key that end after a gap without events."""
    return events.withWatermark(time, delay).groupBy(F.session_window(time, gap).alias("w"), key).agg(F.count("*").alias("events")).select(F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), key, "events")
