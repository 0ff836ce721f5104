"""The library's tables: lookups, duplicates, deletes, coverage, statistics and exports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectorium.session import row_numbers


def current(rows: DataFrame, key: str, time: str) -> DataFrame:
    """One row for each key, the latest delivery; null keys are dropped. A partial maximum is taken before the shuffle."""
    others = [c for c in rows.columns if c != key]
    latest = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*others), F.coalesce(F.col(time), F.lit(0).cast("timestamp"))).alias("_row"))
    return latest.select(key, "_row.*").select(*rows.columns)


def first_where(df: DataFrame, column: str, value: object, order: str) -> DataFrame:
    """The first row (by `order`) whose column has the value; no row if there is none."""
    return df.where(F.col(column) == F.lit(value)).orderBy(order).limit(1)


def books(book: DataFrame) -> DataFrame:
    return book.orderBy("book_id")


def chapters_of(chapter: DataFrame, book_id: int) -> DataFrame:
    return chapter.where(F.col("book_id") == book_id).orderBy("chapter_order")


def chunks_of(chunk: DataFrame, book_id: int) -> DataFrame:
    return chunk.where(F.col("book_id") == book_id).orderBy("chapter_id", "chunk_order")


def new_files(files: DataFrame, book: DataFrame, force: bool = False) -> DataFrame:
    """Files (source_path, file_hash, ...) that are to be ingested.

    Known paths are left out, then known contents; of equal contents the first path stays. `force` keeps all.
    """
    if force:
        return files
    fresh = files.join(book.select("source_path"), "source_path", "left_anti").join(book.select("file_hash"), "file_hash", "left_anti")
    first = fresh.groupBy("file_hash").agg(F.min("source_path").alias("source_path"))
    return fresh.join(first, ["file_hash", "source_path"], "left_semi").select(*files.columns)


def with_ids(rows: DataFrame, stored: DataFrame, key: str, order: list[str]) -> DataFrame:
    """`rows` with ids that go on from the greatest stored one, in the given order; no task sorts all rows."""
    last = stored.agg(F.coalesce(F.max(key), F.lit(0)).alias("last")).first()["last"]
    ranked = row_numbers(rows.drop(key), [], order, key)
    return ranked.withColumn(key, (F.col(key) + int(last)).cast("bigint"))


def without_vectors(chunk: DataFrame, vectors: DataFrame, id_column: str = "chunk_id") -> DataFrame:
    """Chunks that have no vector."""
    return chunk.join(vectors.where("embedding is not null").select(id_column).distinct(), id_column, "left_anti")


def delete_books(tables: dict[str, DataFrame], book_ids: DataFrame) -> dict[str, DataFrame]:
    """Every table of the library without the books in `book_ids` and all that belongs to them.

    `tables` may hold book, chapter, chunk, chunk_vec, chunk_vec_binary, word_postings, trigram_postings and
    ingest_log; the vectors and postings go by the chunks deleted, binary vectors included. Links from elsewhere
    to deleted chunks become null.
    """
    gone = book_ids.select("book_id").distinct()
    chunks = tables["chunk"].join(gone, "book_id", "left_semi").select("chunk_id").distinct()
    out = {}
    for name, table in tables.items():
        columns = table.columns
        kept = table.join(gone, "book_id", "left_anti") if "book_id" in columns else table.join(chunks, "chunk_id", "left_anti")
        if name == "chunk":
            for link in ("prev_chunk_id", "next_chunk_id"):
                if link in columns:
                    dead = chunks.select(F.col("chunk_id").alias(link), F.lit(True).alias("_dead"))
                    kept = kept.join(dead, link, "left").withColumn(link, F.when(F.col("_dead").isNull(), F.col(link))).drop("_dead")
        out[name] = kept.select(*columns)
    return out


def book_statistics(book: DataFrame, chunk: DataFrame) -> DataFrame:
    """(book_id, title, chunks) of every book, 0 for one without chunks."""
    counts = chunk.groupBy("book_id").agg(F.count("*").alias("chunks"))
    return book.select("book_id", "title").join(counts, "book_id", "left").select("book_id", "title", F.coalesce("chunks", F.lit(0)).cast("bigint").alias("chunks"))


def library_statistics(book: DataFrame, chapter: DataFrame, chunk: DataFrame, vectors: DataFrame) -> DataFrame:
    """One row: numbers of books, chapters, chunks, chunks with and without a vector."""
    have = vectors.where("embedding is not null").select("chunk_id").distinct().withColumn("_has", F.lit(1))
    covered = chunk.select("chunk_id").join(have, "chunk_id", "left").agg(F.count("*").alias("chunks"), F.count("_has").alias("embedded"))
    rows = book.agg(F.count("*").alias("books")).crossJoin(chapter.agg(F.count("*").alias("chapters"))).crossJoin(covered)  # single rows
    return rows.select("books", "chapters", "chunks", "embedded", (F.col("chunks") - F.col("embedded")).alias("missing"))


def export_rows(book: DataFrame, chunk: DataFrame, book_id: int | None = None) -> DataFrame:
    """Chunks with their book's title in export order's columns; see sources.export for the order and formats."""
    chosen = book if book_id is None or book_id <= 0 else book.where(F.col("book_id") == book_id)
    rows = chosen.select("book_id", F.col("title").alias("book_title")).join(chunk, "book_id")
    return rows.select("book_id", "book_title", "chapter_id", "chunk_id", "heading", "body", "char_count", F.col("chunk_order"))
