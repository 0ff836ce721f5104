"""Quality of extracted books: sampled pages, classes, repair, and the votes and choices around OCR."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectorium.functions.text import looks_corrupt, non_blank_length, strip
from lectorium.schema import CORRUPT_PAGES, CORRUPT_SHARE, OCR_RETRY_CHARS, PAGE_BATCH, SAMPLE_PAGES
from lectorium.session import row_numbers


def is_sampled(position: Column, total: Column) -> Column:
    """Whether the 0-based position is one of the pages looked at: all of up to nine, else three at start, middle and end."""
    middle = F.floor(total / 2)
    return (total <= SAMPLE_PAGES) | (position <= 2) | position.between(middle - 1, middle + 1) | (position >= total - 3)


def classify(book: DataFrame, page: DataFrame) -> DataFrame:
    """(book_id, quality) of every book: extract_failed without pages, ocr_required if all are blank, text_corrupt if
    enough of the sampled pages look corrupt, else ok. Null texts are blank."""
    pages = page.select("book_id", "page_num", F.coalesce("text", F.lit("")).alias("text")).withColumn("full", strip(F.col("text")) != "")
    every = pages.groupBy("book_id").agg(F.count("*").alias("pages"), F.count_if("full").alias("full_pages"))
    # positions among the pages with text, by rank; only numbers are ranked, in parts of any book; texts are joined after
    places = row_numbers(pages.where("full").select("book_id", "page_num"), ["book_id"], ["page_num"], "place").withColumn("place", F.col("place") - 1).join(every, "book_id")
    sampled = places.where(is_sampled(F.col("place"), F.col("full_pages"))).select("book_id", "page_num")
    checked = pages.where("full").join(sampled, ["book_id", "page_num"], "left_semi").groupBy("book_id").agg(F.count("*").alias("checked"), F.count_if(looks_corrupt(F.col("text"))).alias("corrupt"))
    rows = book.select("book_id").distinct().join(every, "book_id", "left").join(checked, "book_id", "left")
    quality = (
        F.when(F.coalesce("pages", F.lit(0)) == 0, F.lit("extract_failed"))
        .when(F.col("full_pages") == 0, F.lit("ocr_required"))
        .when((F.col("corrupt") >= CORRUPT_PAGES) | (F.col("corrupt") / F.col("checked") >= CORRUPT_SHARE), F.lit("text_corrupt"))
        .otherwise(F.lit("ok"))
    )
    return rows.select("book_id", quality.alias("quality"))


def gate(books: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(books that go on, books that are skipped) by quality; corrupt text goes on with a warning column."""
    skipped = F.coalesce(F.col("quality").isin("ocr_required", "extract_failed"), F.lit(False))
    return books.where(~skipped).withColumn("warning", F.when(F.col("quality") == "text_corrupt", F.lit("text_corrupt"))), books.where(skipped)


def repair_epubs(page: DataFrame, books: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pages, with those of corrupt EPUB books repaired; books, with the quality of the repaired ones worked out again).

    `books` has book_id, book_format and quality. A book none of whose pages the repair changes keeps its quality,
    and so its warning.
    """
    from lectorium.functions.python_udfs import repair_text

    corrupt = books.where("book_format = 'epub' and quality = 'text_corrupt'").select("book_id")
    columns = page.columns
    fixed = page.join(corrupt, "book_id", "left_semi").withColumn("_fixed", repair_text("text"))
    fixed = fixed.withColumn("text", F.col("_fixed.text")).withColumn("_changed", F.col("_fixed.changed")).drop("_fixed")
    pages = page.join(corrupt, "book_id", "left_anti").select(*columns).unionByName(fixed.select(*columns))
    changed = fixed.groupBy("book_id").agg(F.max("_changed").alias("_any")).where("_any").select("book_id")
    again = classify(changed, fixed.join(changed, "book_id", "left_semi")).withColumnRenamed("quality", "_again")
    graded = books.join(again, "book_id", "left").withColumn("quality", F.coalesce("_again", "quality"))
    if "warning" in books.columns:
        graded = graded.withColumn("warning", F.when(F.col("quality") == "text_corrupt", F.lit("text_corrupt")))
    return pages, graded.select(*books.columns)


def ocr_vote(page: DataFrame) -> DataFrame:
    """(book_id, extraction_mode, recommended_batch_size, ocr_candidates): blank pages among first, middle and last."""
    counts = page.groupBy("book_id").agg(F.max("page_num").alias("total"))
    middle = F.greatest(F.lit(1), F.expr("(total + 1) div 2"))
    samples = counts.select("book_id", F.explode(F.array_distinct(F.array(F.lit(1).cast("bigint"), middle.cast("bigint"), F.col("total").cast("bigint")))).alias("page_num"))
    texts = page.select("book_id", F.col("page_num").cast("bigint").alias("page_num"), "text")
    looked = samples.join(texts, ["book_id", "page_num"], "left").groupBy("book_id").agg(F.count("*").alias("n"), F.count_if(strip(F.coalesce("text", F.lit(""))) == "").alias("blank"))
    heavy = F.col("blank") * 2 > F.col("n")
    mode = F.when(heavy, F.lit("ocr-heavy")).otherwise(F.lit("text"))
    return looked.select("book_id", mode.alias("extraction_mode"), F.when(heavy, F.lit(PAGE_BATCH["ocr-heavy"])).otherwise(F.lit(PAGE_BATCH["text"])).alias("recommended_batch_size"), F.col("blank").alias("ocr_candidates"))


def needs_accurate(fast: Column) -> Column:
    """Whether a fast OCR result is so short that the accurate pass should run."""
    return non_blank_length(F.coalesce(fast, F.lit(""))) < OCR_RETRY_CHARS


def preferred_ocr(fast: Column, accurate: Column) -> Column:
    """The accurate text if it was asked for and is longer without blanks, else the fast one."""
    fast, accurate = F.coalesce(fast, F.lit("")), F.coalesce(accurate, F.lit(""))
    return F.when(needs_accurate(fast) & (non_blank_length(accurate) > non_blank_length(fast)), accurate).otherwise(fast)


def ocr_cache_key(file_hash: Column, page_num: Column, scale: Column, level: Column) -> Column:
    return F.sha2(F.concat_ws(":", file_hash, page_num.cast("string"), scale.cast("string"), level.cast("string")), 256)


def with_ocr_cache(pages: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pages whose text is in the cache, pages still to be read). `pages` has cache_key, `cache` (cache_key, text)."""
    kept = cache.where("text is not null").dropDuplicates(["cache_key"])
    return pages.drop("text").join(kept.select("cache_key", "text"), "cache_key"), pages.join(kept, "cache_key", "left_anti")
