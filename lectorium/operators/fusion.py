"""Fusion of ranked lists, and spreading of results over books."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectorium.schema import COMPARISON_BOOKS, RRF_K

#: Places to which fused scores are rounded before they are ranked, as sums of doubles differ in their last digits from run to run.
SCORE_PLACES = 12


def ranked(results: DataFrame, source: str, better: str = "low") -> DataFrame:
    """(query_id, source, chunk_id, rank, score) of scored results: rank by score, ties by chunk_id."""
    score = F.col("score").asc() if better == "low" else F.col("score").desc()
    order = Window.partitionBy("query_id").orderBy(score, "chunk_id")
    return results.select("query_id", F.lit(source).alias("source"), "chunk_id", F.row_number().over(order).alias("rank"), "score")


def reciprocal_rank(lists: list[DataFrame] | DataFrame, limit: int, k: int = RRF_K, source: str = "hybrid") -> DataFrame:
    """Sum of 1 / (k + rank) over the lists, higher is better; no list gives no row of its query."""
    union = lists if isinstance(lists, DataFrame) else lists[0]
    for one in () if isinstance(lists, DataFrame) else lists[1:]:
        union = union.unionByName(one)
    fused = union.groupBy("query_id", "chunk_id").agg(F.round(F.sum(1 / (k + F.col("rank"))), SCORE_PLACES).alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "chunk_id")
    return fused.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit).select("query_id", F.lit(source).alias("source"), "chunk_id", "rank", "score")


def diversify(results: DataFrame, limit: int, spread: Column | None = None) -> DataFrame:
    """Results taken from the books in turn, books in the order of their first result.

    `results` has query_id, book_id and rank. A query of fewer than two books keeps its order; one of a single
    result keeps it whatever the limit. Null books are one book. Where `spread` is given and false, a query's
    results keep their order and are only cut.
    """
    book = F.coalesce(F.col("book_id"), F.lit(0))
    own = Window.partitionBy("query_id", "_book")
    every = Window.partitionBy("query_id")
    placed = results.withColumn("_book", book).withColumn("_turn", F.row_number().over(own.orderBy("rank"))).withColumn("_first", F.min("rank").over(own))
    placed = placed.withColumn("_books", F.size(F.collect_set("_book").over(every))).withColumn("_n", F.count("*").over(every))
    several = F.col("_books") >= COMPARISON_BOOKS
    several = several if spread is None else several & spread
    order = Window.partitionBy("query_id").orderBy(F.when(several, F.col("_turn")).otherwise(F.lit(0)), F.when(several, F.col("_first")).otherwise(F.col("rank")), "rank")
    final = placed.withColumn("_place", F.row_number().over(order)).where((F.col("_place") <= limit) | (F.col("_n") <= 1))
    return final.withColumn("rank", F.col("_place")).drop("_book", "_turn", "_first", "_books", "_n", "_place")
