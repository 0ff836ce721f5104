"""Helpers shared by the text operators: cut lineage, read tables, drop re-delivered rows, take Arrow batches in parts."""

from __future__ import annotations

import os
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectorium.session import checkpointed, row_numbers

__all__ = ["ARROW_ROWS", "bounded_sample", "checkpointed", "in_parts", "local_file", "once", "row_numbers", "shared_file", "table", "vocabulary_path"]

#: Rows that Python works on at a time; with texts of some hundred KB they stay under about 100 MB.
ARROW_ROWS = 500


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def in_parts(batches: Iterator[pa.RecordBatch], rows: int = ARROW_ROWS) -> Iterator[pa.RecordBatch]:
    """Arrow batches, which Spark bounds by their bytes, in slices of at most `rows` rows, so that what Python makes of them stays small."""
    for batch in batches:
        for start in range(0, max(1, batch.num_rows), rows):
            yield batch.slice(start, rows)


def once(df: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """One row for each key with `columns`; re-delivered rows repeat all values, so any of them will do.

    Rows whose key is null are dropped: no result could name them.
    """
    return df.select(key, *columns).where(F.col(key).isNotNull()).dropDuplicates([key])


def vocabulary_path(name: str, folder: str | None = None) -> str:
    """Place of a public tokenizer's file; `folder` or LECTORIUM_TOKENIZERS overrides the usual place."""
    return os.path.join(folder or os.environ.get("LECTORIUM_TOKENIZERS", "/opt/tokenizers"), name)


def shared_file(spark: SparkSession, path: str) -> str:
    """Ships a file to every worker, which finds it by `local_file`; its path, for that."""
    if os.path.exists(path):
        spark.sparkContext.addFile(path)
    return path


def local_file(path: str) -> str:
    """Where a worker has a shipped file; the path itself if it wasn't shipped."""
    place = SparkFiles.get(os.path.basename(path))
    return place if os.path.exists(place) else path


def bounded_sample(df: DataFrame, key: str, rows: int) -> DataFrame:
    """At most `rows` rows of `df`: all of them, or those whose key's hash lies below a bound that lets so many pass.

    The same rows come on every run. Unlike an ordered limit it gathers nothing beyond the sample in one place.
    """
    total = df.count()
    if total <= rows:
        return df
    span = 1 << 40
    return df.where(F.pmod(F.xxhash64(key), F.lit(span)) < int(0.95 * rows / total * span)).limit(rows)
