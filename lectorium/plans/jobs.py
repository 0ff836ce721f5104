"""Extraction in stages that can be resumed: page batches, their manifest, and the pages they gave."""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectorium.operators import orchestrate
from lectorium.sources import storage

#: (ranges) to rows of book_id, page_start, page_end, page_num, text, error: the pages of each range, or its error.
Extract = Callable[[DataFrame], DataFrame]

PAGES = "book_id long, page_start int, page_end int, page_num int, text string"
RANGES = "book_id long, page_start int, page_end int"


@dataclass
class Job:
    """One extraction below `folder`: batches are done once, however often the job is started again.

    `manifest.json` names the rounds of batches that are complete and what failed last; the pages of a round stand
    in a folder of their own, which counts only once the manifest names it. So a job that was killed leaves nothing
    half done, and a batch that was completed isn't read again.
    """

    spark: SparkSession
    folder: str
    job_id: str
    attempts: int = 3
    wait_s: float = 3.0
    rounds: list[int] = field(default_factory=list)
    status: str = "new"
    failed: list[dict] = field(default_factory=list)

    @classmethod
    def open(cls, spark: SparkSession, folder: str, job_id: str, reset: bool = False, **options) -> Job:
        """The job as its manifest has it; `reset` begins it anew."""
        place = f"{folder.rstrip('/')}/{job_id}"
        if reset:
            storage.remove(spark, place)
        job = cls(spark, place, job_id, **options)
        text = storage.read_text(spark, f"{place}/manifest.json")
        if text:
            kept = json.loads(text)
            job.rounds, job.status, job.failed = kept["rounds"], kept["status"], kept["failed"]
        return job

    def _save(self) -> None:
        storage.write_text(self.spark, f"{self.folder}/manifest.json", json.dumps({"job_id": self.job_id, "status": self.status, "rounds": self.rounds, "failed": self.failed}))

    def pages(self) -> DataFrame:
        """(book_id, page_num, text) of all completed batches, in the order of their pages when sorted by page_num."""
        return self._rows().select("book_id", "page_num", "text").where("page_num is not null")

    def completed(self) -> DataFrame:
        """(book_id, page_start, page_end) of the batches that are done, those without pages too."""
        return self._rows().select("book_id", "page_start", "page_end").distinct()

    def _rows(self) -> DataFrame:
        if not self.rounds:
            return self.spark.createDataFrame([], PAGES)
        return self.spark.read.schema(PAGES).parquet(*(f"{self.folder}/pages-{n}" for n in self.rounds))

    def run(self, ranges: DataFrame, extract: Extract) -> bool:
        """Reads the ranges that aren't completed yet, failing ones up to `attempts` times; True if none is left.

        Errors of the last round stay in the manifest until their batches are completed.
        """
        for attempt in range(self.attempts):
            left = orchestrate.pending(ranges.select("book_id", "page_start", "page_end"), self.completed())
            if left.isEmpty():
                break
            if attempt:
                time.sleep(self.wait_s * attempt)
            self.status = "running"
            number = max(self.rounds, default=0) + 1
            place = f"{self.folder}/tried-{number}"
            made = extract(left)
            made.select("book_id", "page_start", "page_end", "page_num", "text", "error").write.mode("overwrite").parquet(place)
            tried = self.spark.read.schema(PAGES + ", error string").parquet(place)
            bad = tried.where("error is not null").groupBy("book_id", "page_start", "page_end").agg(F.min("error").alias("error"))
            good = tried.join(bad, ["book_id", "page_start", "page_end"], "left_anti").drop("error")
            good.write.mode("overwrite").parquet(f"{self.folder}/pages-{number}")
            self.rounds.append(number)
            self.failed = [r.asDict() for r in bad.orderBy("book_id", "page_start").limit(1_000).collect()]  # the first of what failed
            self._save()
            storage.remove(self.spark, place)
        done = orchestrate.pending(ranges.select("book_id", "page_start", "page_end"), self.completed()).isEmpty()
        self.status = "completed" if done else "failed"
        self.failed = [] if done else self.failed
        self._save()
        return done
