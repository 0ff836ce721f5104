"""Nearest vectors: exact search, and sign bits with Hamming distance followed by an exact rank."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectorium.functions import vectors as V
from lectorium.schema import BINARY_OVERSAMPLE, BOOK_OVERFETCH
from lectorium.session import broadcast_if_small


def upsert(stored: DataFrame, new: DataFrame, key: str = "chunk_id") -> DataFrame:
    """`stored` with the rows of `new` in place of those of the same key; both have the same columns."""
    return stored.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def save_batch(stored: DataFrame, chunk: DataFrame, chunk_ids: list[int], vectors: list[list[float]], model: str, replace: bool = True) -> tuple[DataFrame, DataFrame]:
    """(vectors with a batch added, chunks with its model as embedding_version). As many vectors as ids are needed.

    With `replace` the batch takes the place of stored vectors of its ids; without, an id that has one is an error.
    """
    if len(chunk_ids) != len(vectors):
        raise ValueError(f"{len(chunk_ids)} chunks but {len(vectors)} vectors")
    new = stored.sparkSession.createDataFrame([(i, [float(x) for x in v]) for i, v in zip(chunk_ids, vectors)], "chunk_id long, embedding array<float>")
    if not replace and not stored.join(new, "chunk_id", "left_semi").isEmpty():
        raise ValueError("some chunks have a vector already")
    saved = F.broadcast(new.select("chunk_id", F.lit(True).alias("_saved")))  # the batch's ids
    versioned = chunk.join(saved, "chunk_id", "left").withColumn("embedding_version", F.when(F.col("_saved"), F.lit(model)).otherwise(F.col("embedding_version")))
    return upsert(stored.select("chunk_id", "embedding"), new), versioned.select(*chunk.columns)


def delete(stored: DataFrame, chunk_ids: DataFrame) -> DataFrame:
    """`stored` without the vectors of `chunk_ids` (chunk_id)."""
    return stored.join(chunk_ids.select("chunk_id").distinct(), "chunk_id", "left_anti")


def _checked(vectors: DataFrame, id_column: str, vector_column: str, dimension: int | None) -> DataFrame:
    rows = vectors.select(F.col(id_column).alias("chunk_id"), F.col(vector_column).alias("vector")).where("chunk_id is not null and vector is not null")
    return rows if dimension is None else rows.where(F.size("vector") == dimension)


def search(vectors: DataFrame, queries: DataFrame, limit: int, id_column: str = "chunk_id", vector_column: str = "embedding", source: str = "vector", dimension: int | None = None, books: DataFrame | None = None, exact: bool = False) -> DataFrame:
    """Ranked list of the `limit` nearest vectors of each query by L2 distance. `queries`: (query_id, vector).

    A brute-force scan: up to BROADCAST_ROWS queries are sent to every task, more meet the rows partition by
    partition. Each task keeps its own best of each query before the shuffle. With `books` (query_id, chunk_id), the nearest
    BOOK_OVERFETCH x limit are fetched first and filtered after, so fewer than `limit` may come; `exact=True`
    filters first.
    """
    rows = _checked(vectors, id_column, vector_column, dimension)
    asked = queries.select("query_id", F.col("vector").alias("asked"))
    pairs = rows.crossJoin(broadcast_if_small(asked)).select("query_id", "chunk_id", V.l2_distance(F.col("vector"), F.col("asked")).alias("score"))
    if books is not None and exact:
        pairs = pairs.join(books.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_semi")
    order = Window.partitionBy("query_id").orderBy("score", "chunk_id")
    fetch = limit * BOOK_OVERFETCH if books is not None and not exact else limit
    near = pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= fetch)
    if books is not None and not exact:
        near = near.join(books.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_semi").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)
    return near.select("query_id", F.lit(source).alias("source"), "chunk_id", "rank", "score")


def binary_index(vectors: DataFrame, id_column: str = "chunk_id", vector_column: str = "embedding") -> DataFrame:
    """(chunk_id, words): the sign bits of every vector."""
    return _checked(vectors, id_column, vector_column, None).select("chunk_id", V.sign_words(F.col("vector")).alias("words"))


def binary_search(vectors: DataFrame, queries: DataFrame, limit: int, index: DataFrame | None = None, id_column: str = "chunk_id", vector_column: str = "embedding", source: str = "binary", books: DataFrame | None = None) -> DataFrame:
    """Ranked list by cosine distance among the candidates of least Hamming distance.

    BINARY_OVERSAMPLE x limit candidates of each query are kept (with `books`, as many times BOOK_OVERFETCH are
    looked at before the filter); an empty index gives an empty list.
    """
    index = binary_index(vectors, id_column, vector_column) if index is None else index
    asked = queries.select("query_id", F.col("vector").alias("asked"), V.sign_words(F.col("vector")).alias("asked_words"))
    pairs = index.crossJoin(broadcast_if_small(asked.select("query_id", "asked_words")))
    apart = pairs.select("query_id", "chunk_id", V.hamming(F.col("words"), F.col("asked_words")).alias("apart"))
    order = Window.partitionBy("query_id").orderBy("apart", "chunk_id")
    keep = limit * BINARY_OVERSAMPLE
    near = apart.withColumn("place", F.row_number().over(order)).where(F.col("place") <= (keep if books is None else keep * BOOK_OVERFETCH))
    if books is not None:
        near = near.join(books.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_semi").withColumn("place", F.row_number().over(order)).where(F.col("place") <= keep)
    rows = _checked(vectors, id_column, vector_column, None).join(near, "chunk_id").join(asked.select("query_id", "asked"), "query_id")
    scored = rows.select("query_id", "chunk_id", "place", V.cosine_distance(F.col("vector"), F.col("asked")).alias("score")).where("score is not null")
    final = Window.partitionBy("query_id").orderBy("score", "place")
    return scored.withColumn("rank", F.row_number().over(final)).where(F.col("rank") <= limit).select("query_id", F.lit(source).alias("source"), "chunk_id", "rank", "score")
