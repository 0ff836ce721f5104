"""Chapters, their pages, chunks with overlap, and the links between chunks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectorium.functions.text import split_paragraphs, strip
from lectorium.schema import CHUNK_OVERLAP, CHUNK_SIZE, FORCE_SPLIT

#: Fixed value: title of the one chapter of a book without contents.
WHOLE_BOOK = "全体"
_TEXT = "array<string>"


def spread_chapters(titles: DataFrame, pages: DataFrame) -> DataFrame:
    """Chapters of equal page ranges: (book_id, title, chapter_order, page_start, page_end).

    `titles`: (book_id, titles array); `pages`: (book_id, total). The last chapter ends with the book; with more
    titles than pages the last ones have no pages. Books without titles have one chapter over all pages.
    """
    rows = pages.join(titles, "book_id", "left").withColumn("n", F.coalesce(F.size("titles"), F.lit(0)))
    listed = rows.where("n > 0").withColumn("each", F.greatest(F.lit(1), F.expr("total div n"))).select("book_id", "total", "n", "each", F.posexplode("titles").alias("chapter_order", "title"))
    start = F.col("chapter_order") * F.col("each") + 1
    end = F.when(F.col("chapter_order") + 1 < F.col("n"), (F.col("chapter_order") + 1) * F.col("each")).otherwise(F.col("total"))
    columns = ["book_id", "title", F.col("chapter_order").cast("int").alias("chapter_order"), start.cast("int").alias("page_start"), end.cast("int").alias("page_end")]
    single = rows.where("n <= 0").select("book_id", F.lit(WHOLE_BOOK).alias("title"), F.lit(0).alias("chapter_order"), F.lit(1).alias("page_start"), F.col("total").cast("int").alias("page_end"))
    return listed.select(*columns).unionByName(single)


def chapter_ends(starts: DataFrame, pages: DataFrame) -> DataFrame:
    """Chapters that end before the next begins, the last with the book.

    `starts`: (book_id, title, chapter_order, page_start); `pages`: (book_id, total).
    """
    order = Window.partitionBy("book_id").orderBy("chapter_order")  # the chapters of a book
    ended = starts.join(pages, "book_id").withColumn("page_end", F.coalesce(F.lead("page_start").over(order) - 1, F.col("total")).cast("int"))
    return ended.select("book_id", "title", "chapter_order", "page_start", "page_end")


def chapter_pages(page: DataFrame, chapter: DataFrame) -> DataFrame:
    """Pages of each chapter, by page ranges: a page of two chapters comes twice, one of none is left out.

    Ranges are cut to the pages there are and written out by page number, so this is a join on equal keys, which
    splits even when one book holds most pages.
    """
    bounds = page.groupBy("book_id").agg(F.min("page_num").alias("_least"), F.max("page_num").alias("_most"))
    ranges = chapter.where("page_start is not null and page_end is not null").join(bounds, "book_id")
    ranges = ranges.withColumn("_from", F.greatest("page_start", "_least")).withColumn("_to", F.least("page_end", "_most")).where("_from <= _to")
    each = ranges.withColumn("page_num", F.explode(F.sequence("_from", "_to"))).drop("_from", "_to", "_least", "_most", "page_start", "page_end")
    return page.join(each, ["book_id", "page_num"])


#: Pieces that are packed at a time, so that lists which grow by a copy stay short.
_AT_ONCE = 256


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """What `use` makes of `value`, which is bound by a lambda, as else it would be worked out for each of its uses."""
    return F.transform(F.array(value), use)[0]


def _ranges(pieces: Column, size: int) -> Column:
    """Array of (first, count) of the groups of neighbouring pieces, packed up to `size` characters; a larger piece is a group of its own.

    Only lengths are folded, block by block of pieces, so the work grows with the number of pieces.
    """
    state = "struct<length:int,at:int,firsts:array<int>>"
    none = F.array().cast("array<int>")

    def blocks(lengths: Column) -> Column:
        return F.when(F.size(lengths) > 0, F.transform(F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / _AT_ONCE).cast("int")), lambda b: F.slice(lengths, b * _AT_ONCE + 1, F.lit(_AT_ONCE)))).otherwise(F.array().cast("array<array<int>>"))

    def add(s: Column, length: Column) -> Column:
        opens = (s["at"] == 0) | (s["length"] > 0) & (s["length"] + length > size)
        firsts = F.when(opens, F.concat(s["firsts"], F.array(s["at"]))).otherwise(s["firsts"])
        return F.struct(F.when(opens, length).otherwise(s["length"] + length).alias("length"), (s["at"] + 1).alias("at"), firsts.alias("firsts")).cast(state)

    def add_block(s: Column, block: Column) -> Column:
        own = F.aggregate(block, F.struct(s["length"].alias("length"), s["at"].alias("at"), none.alias("firsts")).cast(state), add)
        return _once(own, lambda x: F.struct(x["length"].alias("length"), x["at"].alias("at"), F.concat(s["firsts"], x["firsts"]).alias("firsts"))).cast(state)

    lengths = F.transform(pieces, lambda p: F.length(p))
    firsts = F.aggregate(_once(lengths, blocks), F.struct(F.lit(0).alias("length"), F.lit(0).alias("at"), none.alias("firsts")).cast(state), add_block)["firsts"]
    return F.flatten(F.transform(F.filter(F.array(firsts), lambda f: F.size(f) > 0), lambda f: F.zip_with(f, F.concat(F.slice(f, 2, F.size(f)), F.array(F.size(pieces))), lambda first, after: F.struct(first.alias("first"), (after - first).alias("count")))))


def force_split(text: Column, size: int) -> Column:
    """A long paragraph cut after Japanese sentence ends and line breaks, packed up to `size`; uncuttable text stays whole."""
    pieces = F.split(text, "(?<=[。？！\n])")
    made = _once(pieces, lambda p: F.transform(_ranges(p, size), lambda r: strip(F.array_join(F.slice(p, r["first"] + 1, r["count"]), ""))))
    made = _once(made, lambda m: F.slice(m, 1, F.size(m) - (F.element_at(m, -1) == "").cast("int")))
    return _once(made, lambda m: F.when(F.size(m) > 0, m).otherwise(F.array(text)))


def parts(text: Column, size: int = CHUNK_SIZE) -> Column:
    """The paragraphs of a text, those longer than FORCE_SPLIT times `size` cut."""
    cut = F.transform(split_paragraphs(text), lambda p: F.when(F.length(p) > size * FORCE_SPLIT, force_split(p, size)).otherwise(F.array(p)))
    return F.flatten(cut)


def pack(pieces: Column, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> Column:
    """Array of chunk bodies: parts packed up to `size`, each body after the first led by the end of the one before.

    Only the parts' own characters count against `size`. An overlap of 0 means none.
    """
    back = overlap // 3 + 1  # so many pieces, each of a character and two line breaks at least, hold the overlap

    def body(pieces: Column, r: Column) -> Column:
        own = F.array_join(F.slice(pieces, r["first"] + 1, r["count"]), "\n\n")
        since = F.greatest(r["first"] - back, F.lit(0))
        before = F.right(F.array_join(F.slice(pieces, since + 1, r["first"] - since), "\n\n"), F.lit(overlap))
        return F.when(r["first"] > 0, F.concat(before, F.lit("\n\n"), own)).otherwise(own) if overlap > 0 else own

    return _once(pieces, lambda p: F.transform(_ranges(p, size), lambda r: body(p, r)))


def chunk_texts(df: DataFrame, text_column: str, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> DataFrame:
    """Each row with its text's chunks: adds chunk_order, body, char_count. Rows without a paragraph give none."""
    bodies = df.withColumn("_bodies", pack(parts(F.col(text_column), size), size, overlap)).drop(text_column)
    # outer, as else a filter on the array's size would be inferred and pushed down, packing everything twice
    out = bodies.select("*", F.posexplode_outer("_bodies").alias("chunk_order", "body")).drop("_bodies").where("body is not null")
    return out.withColumn("char_count", F.length("body"))


def chunk_pages(page: DataFrame, chapter: DataFrame, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> DataFrame:
    """(book_id, chapter_order, heading, page_start, page_end, chunk_order, body, char_count).

    The pages of a chapter, in order, are one text; every chunk carries the chapter's first and last page there
    is. Null texts count as empty. The unit of work is a chapter, which a book's text can't outgrow.
    """
    pages = chapter_pages(page.select("book_id", "page_num", F.coalesce("text", F.lit("")).alias("text")), chapter.select("book_id", F.col("title").alias("heading"), "chapter_order", "page_start", "page_end"))
    whole = pages.groupBy("book_id", "chapter_order", "heading").agg(F.array_sort(F.collect_list(F.struct("page_num", "text"))).alias("_pages"), F.min("page_num").alias("page_start"), F.max("page_num").alias("page_end"))
    text = F.array_join(F.transform("_pages", lambda p: p["text"]), "\n\n")
    return chunk_texts(whole.withColumn("_text", text).drop("_pages"), "_text", size, overlap)


def link(chunk: DataFrame) -> DataFrame:
    """Chunks with prev_chunk_id and next_chunk_id of the same chapter, by chunk_order."""
    order = Window.partitionBy("book_id", "chapter_id").orderBy("chunk_order", "chunk_id")  # the chunks of a chapter
    return chunk.withColumn("prev_chunk_id", F.lag("chunk_id").over(order)).withColumn("next_chunk_id", F.lead("chunk_id").over(order))


def known_chapters(chunk: DataFrame, chapter: DataFrame) -> DataFrame:
    """Chunks whose chapter exists, with its chapter_id; the others are dropped."""
    return chunk.join(chapter.select("book_id", "chapter_order", "chapter_id"), ["book_id", "chapter_order"])


def progress_crossings(done: DataFrame, step: int = 100) -> DataFrame:
    """Rows of (job_id, batch, done) whose running count passes a multiple of `step`."""
    order = Window.partitionBy("job_id").orderBy("batch")
    before = F.coalesce(F.lag("done").over(order), F.lit(0))
    return done.withColumn("_before", before).where(F.expr(f"done div {step} > _before div {step}")).drop("_before")
