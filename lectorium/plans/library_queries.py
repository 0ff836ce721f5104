"""More queries over the test tables: lookups, gates, renderings, whole searches and profiles, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectorium.functions import terms as T
from lectorium.operators import catalog, chunking, context, evaluate, knn, lexical, quality
from lectorium.plans.queries import _ASKED, _BEST_OF, _CHUNKS, _DETAILS, _PLAIN_SQL, _TRIGRAM_SEARCH, _WORD_SEARCH, _cut_sql, _details, _docs, _once, _questions, _result_lists, _shown, _t, _top_sql, query
from lectorium.session import row_numbers
from lectorium.sources import exchange
from lectorium.streaming import ingest as streams

_CURRENT_CHUNK = "current_chunk AS (SELECT chunk_id, any_value(book_id) AS book_id, any_value(chapter_id) AS chapter_id, any_value(heading) AS heading, any_value(body) AS body FROM chunk GROUP BY chunk_id)"


# --- lookups --------------------------------------------------------------------------------------------------


@query("""SELECT 'id' AS found_by, book_id, title FROM book WHERE book_id = 7
UNION ALL SELECT 'path', book_id, title FROM book WHERE source_path = (SELECT max(source_path) FROM book)
UNION ALL SELECT 'hash', min(book_id), arg_min(title, book_id) FROM book WHERE file_hash = (SELECT min(file_hash) FROM book)""")
def book_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One book by its id, by a path, and by a hash, of which the first book has it."""
    book = _t(spark, sf_dir, "book")
    known = book.agg(F.max("source_path"), F.min("file_hash")).first()
    found = [catalog.first_where(book, column, value, "book_id").select(F.lit(name).alias("found_by"), "book_id", "title") for name, column, value in (("id", "book_id", 7), ("path", "source_path", known[0]), ("hash", "file_hash", known[1]))]
    return found[0].unionByName(found[1]).unionByName(found[2])


def _placed(ordered: DataFrame, by: list[str]) -> DataFrame:
    """With the place of each row in an order."""
    return row_numbers(ordered, [], by, "place").withColumn("place", F.col("place").cast("bigint"))


@query("SELECT row_number() OVER (ORDER BY book_id) AS place, book_id, title, book_format FROM book")
def list_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All books in their order."""
    return _placed(catalog.books(_t(spark, sf_dir, "book")), ["book_id"]).select("place", "book_id", "title", "book_format")


@query("SELECT row_number() OVER (ORDER BY chapter_order) AS place, chapter_id, title FROM chapter WHERE book_id = 1")
def chapters_of_book(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _placed(catalog.chapters_of(_t(spark, sf_dir, "chapter"), 1), ["chapter_order"]).select("place", "chapter_id", "title")


@query(f"WITH {_CHUNKS} SELECT row_number() OVER (ORDER BY chapter_id NULLS FIRST, chunk_order, chunk_id) AS place, chunk_id, chapter_id, chunk_order FROM chunks WHERE book_id = 1")
def chunks_of_book(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunks of the largest book, by chapter and order."""
    chunk = _once(spark, sf_dir, "chunk", "chunk_id", "book_id", "chapter_id", "chunk_order")
    return _placed(catalog.chunks_of(chunk, 1), ["chapter_id", "chunk_order", "chunk_id"]).select("place", "chunk_id", "chapter_id", "chunk_order")


@query(f"WITH {_CHUNKS} SELECT chunk_id, book_id, heading, sha256(body) AS digest, char_count FROM chunks WHERE chunk_id = (SELECT max(chunk_id) FROM chunks)")
def chunk_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One chunk by its id."""
    chunk = _once(spark, sf_dir, "chunk", "chunk_id", "book_id", "heading", "body", "char_count")
    last = chunk.agg(F.max("chunk_id")).first()[0]
    return catalog.first_where(chunk, "chunk_id", last, "chunk_id").select("chunk_id", "book_id", "heading", F.sha2("body", 256).alias("digest"), "char_count")


# --- gates and joins ------------------------------------------------------------------------------------------


@query("SELECT DISTINCT job_id, book_id, quality, coalesce(quality IN ('ocr_required', 'extract_failed'), false) AS skipped, CASE WHEN quality = 'text_corrupt' THEN 'text_corrupt' END AS warning FROM chunk_response")
def quality_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which answers of the worker go on, are skipped, or go on with a warning."""
    passed, skipped = quality.gate(_once(spark, sf_dir, "chunk_response", "job_id", "book_id", "quality"))
    columns = ["job_id", "book_id", "quality"]
    return passed.select(*columns, F.lit(False).alias("skipped"), "warning").unionByName(skipped.select(*columns, F.lit(True).alias("skipped"), F.lit(None).cast("string").alias("warning")))


@query("SELECT DISTINCT k.chunk_id, c.chapter_id, k.chapter_order FROM (SELECT chunk_id, book_id, chapter_order + chunk_id % 2 AS chapter_order FROM chunk) k JOIN chapter c ON c.book_id = k.book_id AND c.chapter_order = k.chapter_order")
def known_chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks, every second one moved to the next chapter, that find their chapter; the others are dropped."""
    chunk = _once(spark, sf_dir, "chunk", "chunk_id", "book_id", "chapter_order").withColumn("chapter_order", (F.col("chapter_order") + F.col("chunk_id") % 2).cast("int"))
    return chunking.known_chapters(chunk, _t(spark, sf_dir, "chapter")).select("chunk_id", "chapter_id", F.col("chapter_order").cast("bigint").alias("chapter_order"))


@query(f"WITH {_ASKED}, {_PLAIN_SQL} {_WORD_SEARCH}, kept AS (SELECT * FROM word_scored WHERE chunk_id % 3 = 0) {_top_sql('kept', 10)}")
def fts_book_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As bm25_word_topk, within a third of the documents, taken out before the limit; statistics stay those of all."""
    some = _docs(spark, sf_dir).where("chunk_id % 3 = 0").select("chunk_id")
    return _shown(lexical.word_search(_docs(spark, sf_dir), _questions(spark), 10, books=_questions(spark).select("query_id").crossJoin(F.broadcast(some))))  # eight questions


@query(rf"""WITH {_ASKED}, texts AS (SELECT query_id, query AS text FROM questions UNION ALL SELECT 1000 + book_id, title FROM book)
SELECT query_id, NOT regexp_matches(text, '[\x00-/:-@\[-\^`{{-\x7f]' ) OR NOT regexp_matches(regexp_replace(text, '\s', '', 'g'), '[\x00-/:-@\[-\^`{{-\x7f]') AS no_signs, regexp_matches(text, '(^|\s)(AND|OR|NOT|NEAR)(\s|$)') AS operators FROM texts WHERE text IS NOT NULL""")
def strict_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which questions and titles a strict full-text grammar would take as they are: neither signs nor bare operators."""
    rows = _questions(spark).unionByName(_t(spark, sf_dir, "book").select((F.col("book_id") + 1000).alias("query_id"), F.col("title").alias("query"))).where("query is not null")
    operators = F.col("query").rlike("(?:^|\\s)(?:AND|OR|NOT|NEAR)(?:\\s|$)")
    return rows.select("query_id", (T.is_plain_query(F.col("query")) | operators & T.is_plain_query(F.regexp_replace("query", "(?:^|\\s)(?:AND|OR|NOT|NEAR)(?=\\s|$)", " "))).alias("no_signs"), operators.alias("operators"))


@query("SELECT DISTINCT p.page_id, sha256(b.file_hash || ':' || p.page_num || ':2.0:accurate') AS cache_key, p.page_num % 2 = 0 AND p.text IS NOT NULL AS cached FROM page p JOIN book b USING (book_id)")
def ocr_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cache keys of all pages, and which of them a cache of the even pages has."""
    pages = _once(spark, sf_dir, "page", "page_id", "book_id", "page_num", "text").join(_t(spark, sf_dir, "book").select("book_id", "file_hash"), "book_id")
    keyed = pages.withColumn("cache_key", quality.ocr_cache_key(F.col("file_hash"), F.col("page_num"), F.lit("2.0"), F.lit("accurate")))
    cache = keyed.where("page_num % 2 = 0").select("cache_key", "text")
    hit, miss = quality.with_ocr_cache(keyed.select("page_id", "cache_key", "text"), cache)
    return hit.select("page_id", "cache_key", F.lit(True).alias("cached")).unionByName(miss.select("page_id", "cache_key", F.lit(False).alias("cached"))).distinct()


# --- renderings -----------------------------------------------------------------------------------------------


@query(f"WITH {_DETAILS} SELECT query_id, rank, chunk_id, book_title, chapter_title AS chapter, {_cut_sql('body', 300)} AS preview FROM details")
def search_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The JSON answer of each query, read again."""
    details, _ = _details(spark, sf_dir, 10)
    kind = "array<struct<chunk_id:bigint,score:double,book_title:string,chapter:string,preview:string>>"
    items = exchange.results_json(details).select("query_id", F.posexplode(F.from_json("results", kind)).alias("n", "x"))
    ranked = details.select("query_id", F.col("rank").cast("bigint").alias("rank"), "chunk_id")
    return items.select("query_id", "x.*").drop("score").join(ranked, ["query_id", "chunk_id"]).select("query_id", "rank", "chunk_id", "book_title", "chapter", "preview")


def _clip_sql(e: str, n: int) -> str:
    return f"CASE WHEN strlen({e}) > {n} THEN {_cut_sql(e, n)} || '...' ELSE {e} END"


@query(f"WITH {_DETAILS}, s AS (SELECT d.*, f.score FROM details d JOIN fused f USING (query_id, chunk_id)) SELECT query_id, rank, printf('%d. [%.4f] ', rank, score) || concat_ws(', ', coalesce(book_title, 'Unknown'), chapter_title) || chr(10) || '   ' || {_clip_sql('body', 150)} AS line FROM s")
def results_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results as text, with 150 bytes of each body."""
    details, _ = _details(spark, sf_dir, 10)
    return exchange.results_text(details).withColumn("rank", F.col("rank").cast("bigint"))


@query(f"WITH {_CHUNKS} SELECT chunk_id, concat_ws(', ', 'chunk ' || chunk_id, CASE WHEN heading <> '' THEN heading END, CASE WHEN page_start IS NOT NULL AND page_end IS NOT NULL THEN 'pages ' || page_start || '-' || page_end END, char_count || ' characters') || chr(10) || {_clip_sql('body', 500)} AS line FROM chunks WHERE char_count IS NOT NULL")
def chunk_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks as text, with 500 bytes of each body."""
    return exchange.chunk_text(_once(spark, sf_dir, "chunk", "chunk_id", "heading", "body", "page_start", "page_end", "char_count").where("char_count is not null"))


@query(f"SELECT book_id, concat_ws(' ', rpad(book_id::VARCHAR, 4, ' '), rpad(book_format, 6, ' '), CASE WHEN strlen(title) > 50 THEN {_cut_sql('title', 47)} || '...' ELSE title END, strftime(ingested_at, '%Y-%m-%d %H:%M:%S')) AS line FROM book")
def books_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The list of books as text."""
    return exchange.books_text(_t(spark, sf_dir, "book"))


@query("SELECT book_id, coalesce(json(tags)::VARCHAR, '[]') AS tags FROM book")
def tags_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags as a list and again as JSON text."""
    return _t(spark, sf_dir, "book").select("book_id", exchange.tags_json(F.from_json("tags", "array<string>")).alias("tags"))


@query(f"WITH {_DETAILS}, firsts AS (SELECT query_id, book_title, min(rank) AS first FROM details WHERE rank <= 5 AND book_title IS NOT NULL GROUP BY ALL) SELECT query_id, string_agg(book_title, '|' ORDER BY first) AS titles FROM firsts GROUP BY query_id")
def first_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles of the first five results, each once, in their order."""
    details, _ = _details(spark, sf_dir, 10)
    return evaluate.first_titles(details.where("book_title is not null")).select("query_id", F.array_join("titles", "|").alias("titles"))


# --- profiles -------------------------------------------------------------------------------------------------


@query("SELECT min(coalesce(chunk_ms, 0)) AS best_page_extract_ms, median(coalesce(chunk_ms, 0)) AS median_page_extract_ms FROM (SELECT DISTINCT job_id, chunk_ms FROM chunk_response)")
def extract_benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best and median time over runs."""
    return evaluate.extract_benchmark(_once(spark, sf_dir, "chunk_response", "job_id", "chunk_ms").withColumnRenamed("chunk_ms", "page_extract_ms"))


@query("SELECT DISTINCT job_id, status, CASE WHEN status = 'completed' THEN 'completed' WHEN status = 'skipped' AND quality = 'ocr_required' THEN 'ocr_required_extract_only' END AS benchmark_reason, coalesce(status = 'completed' OR status = 'skipped' AND quality = 'ocr_required', false) AS accepted FROM chunk_response")
def accepted_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which runs count for a benchmark, and why."""
    return evaluate.accepted_runs(_once(spark, sf_dir, "chunk_response", "job_id", "status", "quality")).select("job_id", "status", "benchmark_reason", "accepted")


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS events, round(sum(value), 4) AS total FROM events WHERE ts IS NOT NULL GROUP BY ALL")
def windowed_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events in windows of an hour, by the plan that also runs on a stream."""
    return streams.windowed_counts(_t(spark, sf_dir, "events")).withColumn("total", F.round("total", 4))


@query("""WITH gaps AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS opens FROM events WHERE ts IS NOT NULL)
, numbered AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM gaps)
SELECT min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end, user_id, count(*) AS events FROM numbered GROUP BY user_id, n""")
def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of each user that end after 30 minutes without events."""
    return streams.sessions(_t(spark, sf_dir, "events"))


# --- whole searches -------------------------------------------------------------------------------------------


def _asked_vectors(spark: SparkSession, sf_dir: str, vectors: DataFrame) -> DataFrame:
    """The questions, each with the vector of the chunk whose id is 100 times its own."""
    own = vectors.where("chunk_id % 100 = 0").select(F.expr("chunk_id div 100").alias("query_id"), F.col("embedding").alias("vector"))
    return _questions(spark).join(F.broadcast(own.where(F.col("query_id") <= 8)), "query_id", "left")  # eight rows


def _library(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {
        "book": _t(spark, sf_dir, "book"), "chapter": _t(spark, sf_dir, "chapter"), "chunk": catalog.current(_t(spark, sf_dir, "chunk"), "chunk_id", "created_at"),
        "chunk_vec": catalog.current(_t(spark, sf_dir, "chunk_vec"), "chunk_id", "embedded_at").where(F.size("embedding") == 64).select("chunk_id", "embedding"),
    }


_SEARCH = f"""{_BEST_OF.replace('LIMIT_N', '30').replace('documents', '(SELECT chunk_id AS doc_id, heading, body AS text FROM current_chunk)').replace('WITH ', f'WITH {_CURRENT_CHUNK}, ', 1)}
, vectors AS (SELECT chunk_id, any_value(embedding)::DOUBLE[] AS e FROM chunk_vec WHERE len(embedding) = 64 GROUP BY chunk_id)
, lex AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY score, chunk_id) AS r FROM merged)
, near AS (SELECT q.query_id, v.chunk_id, row_number() OVER (PARTITION BY q.query_id ORDER BY list_distance(v.e, a.e), v.chunk_id) AS r FROM vectors v, questions q JOIN vectors a ON a.chunk_id = 100 * q.query_id)
, every AS (SELECT query_id, chunk_id, r FROM lex WHERE r <= 30 UNION ALL SELECT query_id, chunk_id, r FROM near WHERE r <= 30)
, fused AS (SELECT query_id, chunk_id, round(sum(1.0::DOUBLE / (60 + r)), 12) AS score FROM every GROUP BY ALL)
, pool AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM fused)
, details AS (SELECT p.*, c.book_id, coalesce(c.book_id, 0) AS own_book, b.title AS book_title, h.title AS chapter_title, q.query FROM pool p JOIN questions q USING (query_id) JOIN current_chunk c USING (chunk_id) LEFT JOIN book b ON b.book_id = c.book_id LEFT JOIN chapter h ON h.chapter_id = c.chapter_id WHERE rank <= 20)
, spread AS (SELECT query_id, count(DISTINCT own_book) > 1 AND any_value(len(list_filter([{', '.join(f"'{t}'" for t in T.CONTROL_TERMS)}], lambda t: contains(lower(query), t))) > 0) AS spread FROM details GROUP BY query_id)
, turns AS (SELECT d.*, spread, row_number() OVER (PARTITION BY query_id, own_book ORDER BY rank) AS turn, min(rank) OVER (PARTITION BY query_id, own_book) AS first FROM details d JOIN spread USING (query_id))
SELECT query_id, place AS rank, chunk_id, round(score, 9) AS score, book_title, chapter_title FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN spread THEN turn ELSE 0 END, CASE WHEN spread THEN first ELSE rank END, rank) AS place FROM turns) WHERE place <= 10"""


@query(_SEARCH)
def search_hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: hybrid search over the library's chunks with details, spread over books for comparisons."""
    from lectorium.plans.engine import Engine

    tables = _library(spark, sf_dir)
    found = Engine(spark, tables).search(_asked_vectors(spark, sf_dir, tables["chunk_vec"]), 10)
    return found.select("query_id", F.col("rank").cast("bigint").alias("rank"), "chunk_id", F.round("score", 9).alias("score"), "book_title", "chapter_title")


@query("""WITH RECURSIVE batches AS (SELECT book_id AS job_id, ocr_ms::BIGINT AS ms, row_number() OVER (PARTITION BY book_id ORDER BY ocr_ms DESC, batch_id) AS n FROM (SELECT DISTINCT batch_id, book_id, ocr_ms FROM extract_stats) WHERE ocr_ms > 0)
, totals AS (SELECT job_id, count(*) AS batches, sum(ms)::BIGINT AS total FROM batches GROUP BY job_id)
, steps(job_id, workers, n, ends) AS (SELECT job_id, w, 0::BIGINT, list_transform(range(w), lambda i: 0::BIGINT) FROM totals, range(1, 5) t(w)
  UNION ALL SELECT s.job_id, workers, b.n, list_sort(list_append(s.ends[2:], s.ends[1] + b.ms)) FROM steps s JOIN batches b ON b.job_id = s.job_id AND b.n = s.n + 1)
SELECT job_id, workers::INTEGER AS workers, list_max(ends) AS makespan_ms, round(total::DOUBLE / list_max(ends), 3) AS speedup FROM steps JOIN totals USING (job_id) WHERE n = batches""")
def makespan_lpt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Makespans of each book's batches on one to four workers."""
    batches = _once(spark, sf_dir, "extract_stats", "batch_id", "book_id", "ocr_ms").select(F.col("book_id").alias("job_id"), F.col("ocr_ms").alias("batch_ms"))
    return evaluate.makespan(batches)
