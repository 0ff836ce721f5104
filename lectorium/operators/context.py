"""From ranked lists to citations: details of the results, neighbouring chunks, prompt within a budget, sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectorium.functions.text import clipped
from lectorium.schema import PROMPT_BUDGET, PROMPT_PER_CHUNK

SYSTEM_PROMPT = (
    "You help a reader with the books of their library. Below are numbered excerpts; rely on nothing else. Answer in a few sentences in the language of the question, "
    "and put the excerpts' numbers in brackets behind what you take from them. Where they are silent, say that the library doesn't tell."
)
HYDE_PROMPT = "Write a short passage, as it might stand in a book, that answers the question. Give only the passage, in the question's language."


def with_details(results: DataFrame, chunk: DataFrame, book: DataFrame, chapter: DataFrame) -> DataFrame:
    """Results with their chunk (missing ones fall out), book and chapter (missing ones stay null), ranks kept."""
    chunks = chunk.select("chunk_id", "book_id", "chapter_id", "heading", "body", "page_start", "page_end", "prev_chunk_id", "next_chunk_id")
    books = book.select("book_id", F.col("title").alias("book_title"))
    chapters = chapter.select("chapter_id", F.col("title").alias("chapter_title"))
    return results.join(chunks, "chunk_id").join(books, "book_id", "left").join(chapters, "chapter_id", "left")


def with_neighbours(details: DataFrame, chunk: DataFrame) -> DataFrame:
    """Adds prev_body and next_body: chunks before and after in the chapter.

    A neighbour that is a result itself isn't added; one that two results border goes to the first of them, and
    there counts as the one before rather than after.
    """
    sides = details.select("query_id", "rank", F.col("chapter_id").alias("of_chapter"), F.explode(F.array(
        F.struct(F.lit(0).alias("side"), F.col("prev_chunk_id").alias("neighbour")), F.struct(F.lit(1).alias("side"), F.col("next_chunk_id").alias("neighbour")),
    )).alias("x")).select("query_id", "rank", "of_chapter", "x.side", "x.neighbour").where("neighbour is not null")
    hits = details.select("query_id", F.col("chunk_id").alias("neighbour"))
    free = sides.join(hits, ["query_id", "neighbour"], "left_anti")
    bodies = chunk.select(F.col("chunk_id").alias("neighbour"), F.col("chapter_id").alias("its_chapter"), F.col("body").alias("neighbour_body"))
    free = free.join(bodies, "neighbour").where("its_chapter = of_chapter")
    claims = Window.partitionBy("query_id", "neighbour").orderBy("rank", "side")
    claimed = free.withColumn("claim", F.row_number().over(claims)).where("claim = 1")
    wide = claimed.groupBy("query_id", "rank").agg(F.max(F.when(F.col("side") == 0, F.col("neighbour_body"))).alias("prev_body"), F.max(F.when(F.col("side") == 1, F.col("neighbour_body"))).alias("next_body"))
    return details.join(wide, ["query_id", "rank"], "left")


def prompt_entries(details: DataFrame, per_chunk: int = PROMPT_PER_CHUNK, expanded: bool = False) -> DataFrame:
    """Adds `entry`: the excerpt of each result as it stands in a prompt."""
    body = F.col("body")
    text = F.concat_ws("\n\n", F.col("prev_body"), body, F.col("next_body")) if expanded else body
    pages = F.when(F.col("page_start").isNotNull() & F.col("page_end").isNotNull(), F.format_string(" | Pages: %d-%d", "page_start", "page_end"))
    entry = F.concat(
        F.format_string("[%d] ", "rank"), F.coalesce(F.concat(F.lit("Book: "), "book_title"), F.lit("")), F.coalesce(F.concat(F.lit(" | Chapter: "), "chapter_title"), F.lit("")),
        F.coalesce(pages, F.lit("")), F.lit("\n"), F.coalesce(clipped(text, per_chunk), F.lit("")), F.lit("\n---\n"),
    )
    return details.withColumn("entry", entry)


def within_budget(entries: DataFrame, budget: int = PROMPT_BUDGET) -> DataFrame:
    """Entries up to the first that would pass `budget` bytes; the first one always stays, 0 or less means no limit."""
    order = Window.partitionBy("query_id").orderBy("rank")
    running = F.sum(F.octet_length("entry").cast("bigint")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    kept = entries.withColumn("_sum", running).withColumn("_first", F.row_number().over(order))
    return (kept if budget <= 0 else kept.where((F.col("_first") == 1) | (F.col("_sum") <= budget))).drop("_sum", "_first")


def prompts(details: DataFrame, queries: DataFrame, budget: int = PROMPT_BUDGET, per_chunk: int = PROMPT_PER_CHUNK, expanded: bool = False) -> DataFrame:
    """(query_id, system, user): the prompt of each query, from its results. `queries`: (query_id, query)."""
    kept = within_budget(prompt_entries(details, per_chunk, expanded), budget)
    excerpts = kept.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "entry"))).alias("entries"))  # at most a query's results
    user = F.concat(F.lit("Excerpts:\n---\n"), F.array_join(F.transform("entries", lambda e: e["entry"]), ""), F.lit("\nQuestion: "), "query")
    return excerpts.join(queries.select("query_id", "query"), "query_id").select("query_id", F.lit(SYSTEM_PROMPT).alias("system"), user.alias("user"))


def sources(details: DataFrame) -> DataFrame:
    """(query_id, rank, source_line): all results as citations, also those the budget dropped."""
    pages = F.when(F.col("page_start").isNotNull() & F.col("page_end").isNotNull(), F.format_string("pp.%d-%d", "page_start", "page_end"))
    chapter = F.when(F.col("chapter_title") != "", F.col("chapter_title"))
    line = F.concat(F.format_string("[%d] ", "rank"), F.concat_ws(", ", F.coalesce("book_title", F.lit("Unknown")), chapter, pages))
    return details.select("query_id", "rank", line.alias("source_line"))


def formatted_sources(details: DataFrame) -> DataFrame:
    """(query_id, sources): the block of sources of each query."""
    lines = sources(details).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "source_line"))).alias("lines"))
    return lines.select("query_id", F.concat(F.lit("Sources:\n"), F.array_join(F.transform("lines", lambda x: F.concat(x["source_line"], F.lit("\n"))), "")).alias("sources"))
