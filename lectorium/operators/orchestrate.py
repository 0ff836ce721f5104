"""What runs around an ingest: page batches and what is left of them, worker plans, leftovers, warnings."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GIB, MIB = 1 << 30, 1 << 20
#: Tier, most performance cores of it, workers it may use.
TIERS = (("base", 4, 4), ("pro", 7, 6), ("max", None, 8))
#: Mean milliseconds of a warm-up batch below which so many workers pay off.
WORKERS_BY_BATCH_MS = ((1500, 1), (5000, 2), (10000, 4), (20000, 6), (None, 8))
CANDIDATES = (1, 2, 4, 6, 8)


def batch_ranges(books: DataFrame) -> DataFrame:
    """(book_id, batch, page_start, page_end) of each book's page batches. `books`: (book_id, page_count, batch_size)."""
    rows = books.where("page_count > 0 and batch_size > 0")
    each = rows.withColumn("batch", F.explode(F.expr("sequence(0, (page_count - 1) div batch_size)")))
    start = F.col("batch") * F.col("batch_size") + 1
    return each.select("book_id", F.col("batch").cast("int").alias("batch"), start.cast("int").alias("page_start"), F.least(start + F.col("batch_size") - 1, F.col("page_count")).cast("int").alias("page_end"))


def pending(ranges: DataFrame, completed: DataFrame) -> DataFrame:
    """Ranges that aren't among the completed ones (book_id, page_start, page_end)."""
    return ranges.join(completed.select("book_id", "page_start", "page_end").distinct(), ["book_id", "page_start", "page_end"], "left_anti")


def ocr_policy(mode: Column) -> Column:
    """Books of scans go straight to the accurate pass; others decide page by page."""
    return F.when(mode == "ocr-heavy", F.lit("accurate-only")).otherwise(F.lit("auto"))


def target_workers(batch_ms: Column) -> Column:
    """Workers that pay off at this mean time of a batch."""
    made = None
    for bound, workers in WORKERS_BY_BATCH_MS:
        if bound is not None:
            made = (F.when if made is None else made.when)(batch_ms < bound, F.lit(workers))
        else:
            made = made.otherwise(F.lit(workers))
    return made


def host_cap(cores: Column, total_bytes: Column, free_bytes: Column, configured: Column) -> Column:
    """Most workers a host may use: by its tier and setting, two under 8 GiB of memory, one under 256 MiB free."""
    tier = F.when(cores <= TIERS[0][1], TIERS[0][2]).when(cores <= TIERS[1][1], TIERS[1][2]).otherwise(TIERS[2][2])
    cap = F.least(tier, F.when(configured > 0, configured).otherwise(F.lit(8)))
    cap = F.when((total_bytes > 0) & (total_bytes < 8 * GIB), F.least(cap, F.lit(2))).otherwise(cap)
    return F.greatest(F.lit(1), F.when((free_bytes > 0) & (free_bytes < 256 * MIB), F.lit(1)).otherwise(cap))


def planned_workers(batch_ms: Column, cap: Column) -> Column:
    """Greatest usual number of workers within both the target and the cap."""
    most = F.least(target_workers(batch_ms), cap)
    return F.array_max(F.filter(F.array(*map(F.lit, CANDIDATES)), lambda c: c <= F.greatest(most, F.lit(1))))


def workers(setting: str, batch_ms: Column, cap: Column, pending_batches: Column) -> Column:
    """Workers of a run: a fixed number as it is set, else as planned; never more than there are batches left, at least one.

    `batch_ms` and `cap` may be null where the host or the warm-up told nothing: one worker then.
    """
    chosen = F.lit(int(setting)) if setting.isdigit() and int(setting) > 0 else F.when(batch_ms.isNotNull() & cap.isNotNull(), planned_workers(batch_ms, cap)).otherwise(F.lit(1))
    return F.greatest(F.lit(1), F.least(chosen, pending_batches))


#: What the host's own counters are called, and the columns they become.
HOST_COUNTERS = {"hw.perflevel0.physicalcpu": "cores", "hw.memsize": "total_bytes", "page size of": "page_bytes", "Pages free": "free_pages", "Pages inactive": "inactive_pages", "Pages speculative": "speculative_pages"}


def observed_hosts(reports: DataFrame) -> DataFrame:
    """(host, cores, total_bytes, free_bytes) from the text of a host's counters (host, report); what isn't told is null."""
    def told(name: str) -> Column:
        pattern = "page size of (\\d+)" if name == "page size of" else name.replace(".", "\\.") + "\\s*[:=]\\s*(\\d+)"
        found = F.regexp_extract("report", pattern, 1)
        return F.when(found != "", found.cast("bigint"))

    rows = reports.select("host", *(told(name).alias(column) for name, column in HOST_COUNTERS.items()))
    free = (F.col("free_pages") + F.coalesce("inactive_pages", F.lit(0)) + F.coalesce("speculative_pages", F.lit(0))) * F.col("page_bytes")
    return rows.select("host", "cores", "total_bytes", free.alias("free_bytes"))


@dataclass(frozen=True)
class Pruned:
    matched: int
    kept_failed: int
    protected: int
    bytes: int


def prune(jobs: DataFrame, now: Column, older_than_s: int = 168 * 3600, include_failed: bool = False) -> DataFrame:
    """Jobs (job_id, status, changed_at, size) with `outcome`: remove, keep_failed, protect or recent.

    Failed jobs are kept unless asked for; jobs neither completed nor failed are protected; the rest go once they
    are old enough.
    """
    age = F.unix_micros(now) - F.unix_micros(F.col("changed_at"))
    status = F.coalesce("status", F.lit(""))
    outcome = (
        F.when((status == "failed") & F.lit(not include_failed), F.lit("keep_failed"))
        .when(~status.isin("completed", "failed"), F.lit("protect"))
        .when(F.coalesce(age, F.lit(0)) < older_than_s * 1_000_000, F.lit("recent"))
        .otherwise(F.lit("remove"))
    )
    return jobs.withColumn("outcome", outcome)


def embedding_failures(counts: DataFrame) -> DataFrame:
    """(.., failed_ratio, warn) from (failed, total): a warning above half."""
    ratio = F.when(F.col("total") > 0, F.col("failed") / F.col("total")).otherwise(F.lit(0.0))
    return counts.withColumn("failed_ratio", ratio).withColumn("warn", ratio > 0.5)


def warm_up_mean(times: Sequence[int]) -> int:
    """Mean of the warm-up batches in whole milliseconds; 0 without any."""
    return sum(times) // len(times) if times else 0
