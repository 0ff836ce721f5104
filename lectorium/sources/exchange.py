"""Reading and writing: JSON lines, exports, JSON answers and text tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectorium.functions.text import clipped, cut_bytes
from lectorium.schema import CHUNK_INFO, PAGE

EXPORT_COLUMNS = ("book_id", "book_title", "chapter_id", "chunk_id", "heading", "body", "char_count", "chunk_order")


def read_lines(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """JSON lines of a given schema; blank lines are skipped, a broken one is an error."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    return read_lines(spark, path, PAGE)


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    return read_lines(spark, path, CHUNK_INFO)


def write_lines(df: DataFrame, path: str) -> None:
    """JSON lines in UTF-8; missing folders are made, null fields kept."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def export(rows: DataFrame, path: str, kind: str = "json") -> None:
    """Chunks in the order of book, chapter and chunk, as JSON lines or CSV with a header."""
    if kind not in ("json", "csv"):
        raise ValueError(f"unsupported format: {kind} (json or csv)")
    ordered = rows.select(*EXPORT_COLUMNS).orderBy("book_id", "chapter_id", "chunk_order")
    if kind == "json":
        ordered.write.mode("overwrite").option("ignoreNullFields", "false").json(path)
    else:
        ordered.write.mode("overwrite").option("header", "true").option("quote", '"').option("escape", '"').csv(path)


def preview(body: Column, limit: int) -> Column:
    """First `limit` bytes, never part of a character, without a mark."""
    return cut_bytes(body, limit)


def results_json(details: DataFrame) -> DataFrame:
    """(query_id, results): the results of each query as one JSON array, with previews of 300 bytes."""
    item = F.struct(F.col("rank"), "chunk_id", "score", "book_title", F.col("chapter_title").alias("chapter"), preview(F.col("body"), 300).alias("preview"))
    return details.groupBy("query_id").agg(F.to_json(F.transform(F.array_sort(F.collect_list(item)), lambda x: x.dropFields("rank"))).alias("results"))


def results_text(details: DataFrame) -> DataFrame:
    """(query_id, rank, line): a result as text with its score to four places and 150 bytes of its body."""
    where = F.concat_ws(", ", F.coalesce("book_title", F.lit("Unknown")), F.col("chapter_title"))
    line = F.concat(F.format_string("%d. [%.4f] ", "rank", "score"), where, F.lit("\n   "), clipped(F.col("body"), 150))
    return details.select("query_id", "rank", line.alias("line"))


def chunk_text(chunk: DataFrame) -> DataFrame:
    """(chunk_id, line): a chunk as text, its body cut to 500 bytes."""
    pages = F.when(F.col("page_start").isNotNull() & F.col("page_end").isNotNull(), F.format_string("pages %d-%d", "page_start", "page_end"))
    head = F.concat_ws(", ", F.concat(F.lit("chunk "), F.col("chunk_id").cast("string")), F.when(F.col("heading") != "", F.col("heading")), pages, F.format_string("%d characters", "char_count"))
    return chunk.select("chunk_id", F.concat(head, F.lit("\n"), clipped(F.col("body"), 500)).alias("line"))


def books_text(book: DataFrame) -> DataFrame:
    """(book_id, line): the list of books, titles above 50 bytes cut to 47."""
    title = F.when(F.octet_length("title") > 50, F.concat(cut_bytes(F.col("title"), 47), F.lit("..."))).otherwise(F.col("title"))
    return book.select("book_id", F.concat_ws(" ", F.rpad(F.col("book_id").cast("string"), 4, " "), F.rpad("book_format", 6, " "), title, F.date_format("ingested_at", "yyyy-MM-dd HH:mm:ss")).alias("line"))


def tags_json(tags: Column) -> Column:
    """A list of tags as JSON text, null as an empty list."""
    return F.to_json(F.coalesce(tags, F.array().cast("array<string>")))
