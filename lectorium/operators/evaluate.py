"""Evaluation of retrieval and profiles of the pipeline."""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectorium.schema import HIT_CUTOFF


def nearest_rank(column: str, ratio: float) -> Column:
    """Percentile by nearest rank; 0 over no rows."""
    return F.coalesce(F.expr(f"percentile_disc({ratio}) within group (order by {column})").cast("double"), F.lit(0.0))


def _matches(titles: Column, fragment: Column) -> Column:
    return F.exists(titles, lambda t: F.contains(t, fragment))


def hit_rate(results: DataFrame, expected: DataFrame, cutoff: int = HIT_CUTOFF) -> DataFrame:
    """(query_id, hit): whether each expected title fragment is in a title of the first results.

    `results`: (query_id, rank, book_title); `expected`: (query_id, titles). Titles are compared as they come, so
    normalise both (functions.python_udfs.normalize_title). A query without results misses unless it expects none.
    """
    top = results.where(F.col("rank") <= cutoff).groupBy("query_id").agg(F.collect_set("book_title").alias("found"))  # at most `cutoff` titles
    rows = expected.join(top, "query_id", "left").withColumn("found", F.coalesce("found", F.array().cast("array<string>")))
    return rows.select("query_id", F.forall("titles", lambda t: _matches(F.col("found"), t)).alias("hit"))


def first_titles(results: DataFrame, cutoff: int = HIT_CUTOFF) -> DataFrame:
    """(query_id, titles): the titles of the first results, each once, in their order."""
    top = results.where(F.col("rank") <= cutoff).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "book_title"))).alias("top"))  # at most `cutoff` rows
    return top.select("query_id", F.array_distinct(F.transform("top", lambda x: x["book_title"])).alias("titles"))


def rate(hits: DataFrame) -> DataFrame:
    """One row: hits, total, rate."""
    return hits.agg(F.count_if("hit").alias("hits"), F.count("*").alias("total")).select("hits", "total", F.when(F.col("total") > 0, F.col("hits") / F.col("total")).otherwise(F.lit(0.0)).alias("rate"))


def source_coverage(sources: DataFrame, expected: DataFrame) -> DataFrame:
    """(query_id, coverage): percent of the expected titles among a query's sources, to one place; null if none is expected."""
    found = sources.groupBy("query_id").agg(F.collect_set("book_title").alias("found"))
    rows = expected.join(found, "query_id", "left").withColumn("found", F.coalesce("found", F.array().cast("array<string>")))
    share = F.size(F.filter("titles", lambda t: _matches(F.col("found"), t))) / F.size("titles") * 100
    return rows.select("query_id", F.when(F.size("titles") > 0, F.round(share, 1)).alias("coverage"))


def latency_summary(asks: DataFrame) -> DataFrame:
    """One row of nearest-rank percentiles over positive latencies total_ms, retrieval_ms, generation_ms."""
    picks = (("median_total_ms", "total_ms", 0.5), ("p95_total_ms", "total_ms", 0.95), ("median_retrieval_ms", "retrieval_ms", 0.5), ("median_generation_ms", "generation_ms", 0.5))
    return asks.agg(F.count("*").alias("total"), *[nearest_rank(f"case when {c} > 0 then {c} end", ratio).alias(name) for name, c, ratio in picks])


def ingest_summary(profiles: DataFrame) -> DataFrame:
    """One row over ingest profiles (status, chunks, embed_model, total_ms, chunk_ms, ocr_pages, ocr_ms): counts, sums,
    interpolated medians over completed ones, sorted distinct models."""
    done = F.col("status") == "completed"

    def total(column: str) -> Column:
        return F.coalesce(F.sum(F.when(done, F.col(column))), F.lit(0)).cast("bigint")

    def middle(column: str) -> Column:
        return F.coalesce(F.median(F.when(done, F.coalesce(column, F.lit(0)))), F.lit(0.0))

    return profiles.agg(
        F.count("*").alias("books"), F.count_if(done).alias("completed_books"), F.count_if(done & (F.col("chunks") > 0)).alias("effective_books"),
        F.sort_array(F.collect_set(F.when(F.col("embed_model") != "", F.col("embed_model")))).alias("models"),
        total("chunks").alias("total_chunks"), total("chunk_ms").alias("total_chunk_ms"), total("ocr_pages").alias("total_ocr_pages"), total("ocr_ms").alias("total_ocr_ms"),
        middle("total_ms").alias("median_total_ms"), middle("chunk_ms").alias("median_chunk_ms"), middle("ocr_ms").alias("median_ocr_ms"),
    )


def extract_benchmark(runs: DataFrame) -> DataFrame:
    """One row of best and median page extraction over benchmark runs."""
    return runs.agg(F.min(F.coalesce("page_extract_ms", F.lit(0))).alias("best_page_extract_ms"), F.median(F.coalesce("page_extract_ms", F.lit(0))).alias("median_page_extract_ms"))


def accepted_runs(profiles: DataFrame) -> DataFrame:
    """Runs with `accepted` and `benchmark_reason`: completed ones, and skipped ones that would need OCR."""
    reason = F.when(F.col("status") == "completed", F.lit("completed")).when((F.col("status") == "skipped") & (F.col("quality") == "ocr_required"), F.lit("ocr_required_extract_only"))
    return profiles.withColumn("benchmark_reason", reason).withColumn("accepted", reason.isNotNull())


def makespan_of(durations: list[int], workers: int) -> int:
    """Time until all batches are done if the longest is started first on the worker that is free first."""
    if workers <= 1:
        return sum(durations)
    ends = [0] * workers
    for duration in sorted(durations, reverse=True):
        heapq.heappush(ends, heapq.heappop(ends) + duration)
    return max(ends) if durations else 0


def makespan(batches: DataFrame, workers: tuple[int, ...] = (1, 2, 3, 4)) -> DataFrame:
    """(job_id, workers, makespan_ms, speedup) of each job's batches (job_id, batch_ms); times of 0 or less don't count.

    Sequential by nature, so a job's batches meet in one task; only their times are sent there.
    """

    def run(job: pd.DataFrame) -> pd.DataFrame:
        times = [int(x) for x in job["batch_ms"]]
        spans = [makespan_of(times, w) for w in workers]
        return pd.DataFrame({"job_id": [job["job_id"].iloc[0]] * len(workers), "workers": list(workers), "makespan_ms": spans, "speedup": [round(sum(times) / s, 3) if s else 0.0 for s in spans]})

    kind = batches.schema["job_id"].dataType.simpleString()
    return batches.where("batch_ms > 0").select("job_id", F.col("batch_ms").cast("bigint").alias("batch_ms")).groupBy("job_id").applyInPandas(run, f"job_id {kind}, workers int, makespan_ms bigint, speedup double")


def stats_rollup(stats: DataFrame, key: str = "book_id") -> DataFrame:
    """Sums of the OCR counters of all batches, null counting as 0."""
    counters = ("ocr_pages", "ocr_retries", "ocr_ms", "ocr_fast_pages", "ocr_retry_pages", "ocr_fast_ms", "ocr_retry_ms")
    return stats.groupBy(key).agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c) for c in counters])
