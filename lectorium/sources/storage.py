"""Small files on any file system Spark knows: pointers and manifests."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _place(spark: SparkSession, path: str):
    """(file system, path) by Hadoop's means."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def exists(spark: SparkSession, path: str) -> bool:
    files, place = _place(spark, path)
    return files.exists(place)


def folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders directly in `path`; none if it isn't there."""
    files, place = _place(spark, path)
    return [s.getPath().getName() for s in files.listStatus(place) if s.isDirectory()] if files.exists(place) else []


def remove(spark: SparkSession, path: str) -> None:
    files, place = _place(spark, path)
    files.delete(place, True)


def read_text(spark: SparkSession, path: str) -> str | None:
    """What a small file holds; None if it isn't there."""
    files, place = _place(spark, path)
    if not files.exists(place):
        return None
    stream = files.open(place)
    try:
        return bytes(stream.readAllBytes()).decode("utf-8")
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Writes a small file beside its place and then moves it there, so that a reader sees it whole or not at all."""
    files, place = _place(spark, path)
    beside = spark._jvm.org.apache.hadoop.fs.Path(path + ".new")
    stream = files.create(beside, True)
    try:
        stream.write(bytearray(text.encode("utf-8")))
    finally:
        stream.close()
    files.delete(place, False)
    if not files.rename(beside, place):
        raise OSError(f"can't move {path}.new to its place")
