"""Record types of the library and its fixed constants."""

from __future__ import annotations

from pyspark.sql import types as T

LONG, INT, STRING, TIME = T.LongType(), T.IntegerType(), T.StringType(), T.TimestampType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


BOOK = _struct(book_id=LONG, title=STRING, author=STRING, book_format=STRING, source_path=STRING, file_hash=STRING, tags=STRING, page_count=INT, ingested_at=TIME, updated_at=TIME)
CHAPTER = _struct(chapter_id=LONG, book_id=LONG, title=STRING, chapter_order=INT, page_start=INT, page_end=INT)
PAGE = _struct(book_id=LONG, page_num=INT, text=STRING)
CHUNK = _struct(
    chunk_id=LONG, book_id=LONG, chapter_id=LONG, heading=STRING, body=STRING, char_count=INT, page_start=INT, page_end=INT, chunk_order=INT,
    prev_chunk_id=LONG, next_chunk_id=LONG, embedding_version=STRING, created_at=TIME,
)
CHUNK_INFO = _struct(chapter_order=INT, heading=STRING, body=STRING, char_count=INT, page_start=INT, page_end=INT, chunk_order=INT)
CHUNK_VEC = _struct(chunk_id=LONG, embedding=T.ArrayType(T.FloatType()))
CHUNK_VEC_BINARY = _struct(chunk_id=LONG, words=T.ArrayType(LONG))
INGEST_LOG = _struct(log_id=LONG, book_id=LONG, status=STRING, message=STRING, created_at=TIME)
SCHEMA_VERSION = _struct(version=INT, applied_at=TIME)
#: Every retrieval step takes and gives this relation; lower rank is better whatever the score's direction.
RANKED = _struct(query_id=LONG, source=STRING, chunk_id=LONG, rank=INT, score=T.DoubleType())

#: Versions of the stored tables, in the order in which they are applied.
MIGRATIONS = ((1, "book, chapter, chunk, chunk_vec, ingest_log"), (2, "word index"), (3, "binary vectors"))

BOOK_FORMATS = ("pdf", "epub")
LOG_STATUSES = ("started", "extracted", "chunked", "embedded", "completed", "failed")

RRF_K = 60
FETCH_MULTIPLIER = 3
COMPARISON_POOL = 2
COMPARISON_BOOKS = 2
BOOK_OVERFETCH = 5
BINARY_OVERSAMPLE = 5
BM25_K1, BM25_B, BM25_LEAST_IDF = 1.2, 0.75, 1e-6
CHUNK_SIZE, CHUNK_OVERLAP, FORCE_SPLIT = 500, 100, 2
PROMPT_BUDGET, PROMPT_PER_CHUNK, PROMPT_PER_CHUNK_EXPANDED = 3000, 500, 1200
CORRUPT_SAMPLE, CORRUPT_RUN, CORRUPT_RATIO = 4000, 3, 0.02
CORRUPT_PAGES, CORRUPT_SHARE, SAMPLE_PAGES = 3, 0.25, 9
OCR_RETRY_CHARS = 50
PAGE_BATCH = {"text": 64, "ocr-heavy": 16}
HIT_CUTOFF = 5


def pending_migrations(applied: list[int]) -> list[int]:
    """Versions above the greatest one applied, in order; nothing applied counts as version 0."""
    last = max(applied, default=0)
    return [version for version, _ in MIGRATIONS if version > last]
