"""Queries over the test tables, each with the SQL it is checked against where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectorium.functions import terms as T
from lectorium.functions import text as X
from lectorium.operators import catalog, chunking, context, evaluate, fusion, knn, lexical, orchestrate, quality
from lectorium.sources import exchange

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

#: The questions that the lexical and hybrid queries ask.
QUESTIONS = (
    (1, "annotated catalogue margin"), (2, "reading room lantern"), (3, "compare the quiet harbour and the faded orchard"), (4, "索引とカタログ"), (5, "Größe der Bibliothek"),
    (6, "both retrieval and embedding"), (7, "vocabulary vocabulary"), (8, "technical 技術文書"),
)


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _questions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(QUESTIONS, "query_id long, query string")


def _once(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """Distinct rows without the delivery time: re-delivered rows repeat all other values."""
    return _t(spark, sf_dir, name).select(*columns).distinct()


def _values() -> str:
    return ", ".join("({}, '{}')".format(i, q.replace("'", "''")) for i, q in QUESTIONS)


_ASKED = f"questions(query_id, query) AS (VALUES {_values()})"


def _fold(column: str) -> str:
    return f"translate(lower({column}), '{T.ACCENTED}ς', '{T.PLAIN}σ')"


def _words_sql(column: str) -> str:
    """Folded segments: runs of Han, Hiragana and Katakana are set apart by blanks, as RE2 can't subtract classes."""
    return rf"regexp_extract_all(regexp_replace({_fold(column)}, '(\p{{Han}}+|\p{{Hiragana}}+|[\p{{Katakana}}ー]+)', ' \1 ', 'g'), '[\p{{L}}\p{{N}}\p{{M}}]+')"


_WORD_SEARCH = f"""
, docs AS (SELECT doc_id AS chunk_id, list_concat({_words_sql("coalesce(heading, '')")}, {_words_sql("coalesce(text, '')")}) AS terms FROM documents)
, corpus AS (SELECT count(*) AS n_rows, avg(len(terms)) AS mean FROM docs)
, asked AS (SELECT query_id, term, count(*) AS times FROM (SELECT query_id, unnest(list_filter({_words_sql("query")}, lambda x: length(x) > 1)) AS term FROM expanded) GROUP BY ALL)
, flat AS (SELECT chunk_id, len(terms) AS length, unnest(terms) AS term FROM docs)
, post AS (SELECT term, chunk_id, length, count(*) AS tf FROM flat WHERE term IN (SELECT term FROM asked) GROUP BY ALL)
, df AS (SELECT term, count(*) AS n FROM post GROUP BY term)
, word_scored AS (SELECT query_id, chunk_id, round(sum(times * -(CASE WHEN ln((n_rows - n + 0.5) / (n + 0.5)) <= 0 THEN 1e-6 ELSE ln((n_rows - n + 0.5) / (n + 0.5)) END) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean))), 9) AS score
  FROM post JOIN asked USING (term) JOIN df USING (term), corpus GROUP BY ALL)
"""
_TRIGRAM_SEARCH = """
, tdocs AS (SELECT doc_id AS chunk_id, lower(coalesce(heading, '')) AS head, lower(coalesce(text, '')) AS body FROM documents)
, tlen AS (SELECT *, greatest(length(head) - 2, 0) + greatest(length(body) - 2, 0) AS length FROM tdocs)
, tcorpus AS (SELECT count(*) AS n_rows, avg(length) AS mean FROM tlen)
, tasked AS (SELECT query_id, term, count(*) AS times FROM (SELECT query_id, unnest(list_filter(string_split_regex(lower(trim(query)), '\\s+'), lambda x: length(x) >= 3)) AS term FROM expanded) GROUP BY ALL)
, tneed AS (SELECT query_id, sum(times) AS needed FROM tasked GROUP BY query_id)
, tterms AS (SELECT DISTINCT term FROM tasked)
, thits AS (SELECT chunk_id, length, term,
    len(list_filter(range(1, length(head) + 1), lambda i: substr(head, i, length(term)) = term)) AS in_head,
    (length(body) - length(replace(body, term, ''))) // length(term) AS in_body
  FROM tlen, tterms WHERE contains(head, term) OR contains(body, term))
, tcount AS (SELECT chunk_id, length, term, in_head + in_body AS tf FROM thits)
, tdf AS (SELECT term, count(*) AS n FROM tcount GROUP BY term)
, tri_scored AS (SELECT query_id, chunk_id, score FROM (SELECT query_id, chunk_id, sum(times) AS matched, round(sum(times * -(CASE WHEN ln((n_rows - n + 0.5) / (n + 0.5)) <= 0 THEN 1e-6 ELSE ln((n_rows - n + 0.5) / (n + 0.5)) END) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean))), 9) AS score
  FROM tcount JOIN tasked USING (term) JOIN tdf USING (term), tcorpus GROUP BY ALL) JOIN tneed USING (query_id) WHERE matched = needed)
"""


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "heading", F.col("text").alias("body"))


def _shown(ranked: DataFrame, places: int = 6) -> DataFrame:
    return ranked.select("query_id", F.col("rank").cast("bigint").alias("rank"), "chunk_id", F.round("score", places).alias("score"))


def _top_sql(scored: str, limit: int, places: int = 6, direction: str = "") -> str:
    return f"SELECT query_id, rank, chunk_id, round(score, {places}) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score {direction}, chunk_id) AS rank FROM {scored}) WHERE rank <= {limit}"


# the synonyms 技術 and 文書 are in the alias's own name, so only the third is added
_EXPANDED_SQL = "expanded AS (SELECT query_id, CASE WHEN contains(lower(query), '技術文書') THEN query || ' テクニカルライティング' ELSE query END AS query FROM questions)"
_PLAIN_SQL = "expanded AS (SELECT * FROM questions)"


@query(f"WITH {_ASKED}, {_PLAIN_SQL} {_WORD_SEARCH} {_top_sql('word_scored', 10)}")
def bm25_word_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BM25 over words of all documents, ten best of each question."""
    return _shown(lexical.word_search(_docs(spark, sf_dir), _questions(spark), 10))


@query(f"WITH {_ASKED}, {_PLAIN_SQL} {_TRIGRAM_SEARCH} {_top_sql('tri_scored', 10)}")
def bm25_trigram_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BM25 over substrings; all terms must be there."""
    return _shown(lexical.trigram_search(_docs(spark, sf_dir), _questions(spark), 10))


_BEST_OF = f"""WITH {_ASKED}, {_EXPANDED_SQL} {_WORD_SEARCH} {_TRIGRAM_SEARCH}
, lists AS (SELECT query_id, chunk_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, chunk_id) AS r FROM word_scored) WHERE r <= LIMIT_N UNION ALL SELECT query_id, chunk_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, chunk_id) AS r FROM tri_scored) WHERE r <= LIMIT_N)
, merged AS (SELECT query_id, chunk_id, min(score) AS score FROM lists GROUP BY ALL)"""


@query(f"{_BEST_OF.replace('LIMIT_N', '10')} {_top_sql('merged', 10)}")
def fts_best_of_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expanded questions in both indexes, best score of each document."""
    return _shown(lexical.search(_docs(spark, sf_dir), _questions(spark), 10))


# --- vectors -------------------------------------------------------------------------------------------------


def _vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    vectors = _t(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding", "label")
    asked = vectors.where("chunk_id % 100 = 0").select(F.col("chunk_id").alias("query_id"), F.col("embedding").alias("vector"))
    return vectors, asked


_KNN = """WITH asked AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS a FROM embeddings WHERE vec_id % 100 = 0)
, pairs AS (SELECT query_id, vec_id AS chunk_id, label, list_distance(embedding::DOUBLE[], a) AS score FROM embeddings, asked)"""


@query(f"{_KNN} {_top_sql('pairs', 10, 5)}")
def knn_l2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten nearest vectors by L2 of every vector whose id is divisible by 100."""
    vectors, asked = _vectors(spark, sf_dir)
    return _shown(knn.search(vectors, asked, 10), 5)


@query(f"{_KNN}, ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, chunk_id) AS r FROM pairs), kept AS (SELECT * FROM ranked WHERE r <= 50 AND label = 3) {_top_sql('kept', 10, 5)}")
def knn_book_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As knn_l2_topk within label 3, filtered after five times as many were fetched."""
    vectors, asked = _vectors(spark, sf_dir)
    books = asked.select("query_id").join(vectors.where("label = 3").select("chunk_id"))
    return _shown(knn.search(vectors, asked, 10, books=books), 5)


@query("SELECT vec_id AS chunk_id, list_sum(list_transform(range(1, 33), lambda i: CASE WHEN embedding[i] > 0 THEN (1::BIGINT << (i - 1)::BIGINT) ELSE 0 END))::BIGINT AS low_bits, list_sum(list_transform(embedding, lambda x: CASE WHEN x > 0 THEN 1 ELSE 0 END))::BIGINT AS set_bits FROM embeddings")
def binary_quantize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sign bits of every vector: the lower 32 as a number, and how many are set."""
    index = knn.binary_index(_vectors(spark, sf_dir)[0])
    return index.select("chunk_id", F.col("words")[0].bitwiseAND(F.lit(2**32 - 1)).alias("low_bits"), F.aggregate("words", F.lit(0), lambda n, w: n + F.bit_count(w)).cast("bigint").alias("set_bits"))


@query(f"""WITH asked AS (SELECT vec_id AS query_id, embedding AS a FROM embeddings WHERE vec_id % 100 = 0)
, apart AS (SELECT query_id, vec_id AS chunk_id, list_sum(list_transform(list_zip(embedding, a), lambda p: CASE WHEN (p[1] > 0) <> (p[2] > 0) THEN 1 ELSE 0 END)) AS h, list_cosine_distance(embedding::DOUBLE[], a::DOUBLE[]) AS d FROM embeddings, asked)
, placed AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY h, chunk_id) AS place FROM apart)
SELECT query_id, rank, chunk_id, round(d, 5) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, place) AS rank FROM placed WHERE place <= 50) WHERE rank <= 10""")
def hamming_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fifty candidates by Hamming distance, ten best by cosine distance."""
    vectors, asked = _vectors(spark, sf_dir)
    return _shown(knn.binary_search(vectors, asked, 10), 5)


# --- fusion ---------------------------------------------------------------------------------------------------


def _result_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ranked lists of search_result: one row for each chunk of a list, best score, ranks by direction."""
    lists = _t(spark, sf_dir, "score_list")
    inside = F.get_json_object("item_json", "$.score").cast("double")
    score = F.coalesce(F.when(~F.isnan("score"), F.col("score")), inside)
    rows = _t(spark, sf_dir, "search_result").select("query_id", "score_list", "chunk_id", score.alias("score")).where("score is not null and not isnan(score)").join(F.broadcast(lists), "score_list")
    signed = rows.withColumn("signed", F.when(F.col("better") == "high", -F.col("score")).otherwise(F.col("score")))
    best = signed.groupBy("query_id", "score_list", "chunk_id").agg(F.min("signed").alias("score"))
    order = Window.partitionBy("query_id", "score_list").orderBy("score", "chunk_id")
    return best.select("query_id", F.col("score_list").alias("source"), "chunk_id", F.row_number().over(order).alias("rank"), "score")


_LISTS = """scored AS (SELECT query_id, score_list, chunk_id, CASE WHEN score IS NULL OR isnan(score) THEN json_extract(item_json, '$.score')::DOUBLE ELSE score END AS s, better FROM search_result JOIN score_list USING (score_list))
, best AS (SELECT query_id, score_list, chunk_id, min(CASE WHEN better = 'high' THEN -s ELSE s END) AS score FROM scored WHERE s IS NOT NULL AND NOT isnan(s) GROUP BY ALL)
, lists AS (SELECT *, row_number() OVER (PARTITION BY query_id, score_list ORDER BY score, chunk_id) AS r FROM best)
, fused AS (SELECT query_id, chunk_id, round(sum(1.0::DOUBLE / (60 + r)), 12) AS score FROM lists GROUP BY ALL)"""


@query(f"WITH {_LISTS} {_top_sql('fused', 20, 9, 'DESC')}")
def rrf_search_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reciprocal rank fusion of all lists of each query."""
    fused = fusion.reciprocal_rank(_result_lists(spark, sf_dir), 20)
    return _shown(fused.withColumn("score", F.col("score")), 9)


@query(f"""WITH {_LISTS}
, pool AS (SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM fused)
, once AS (SELECT DISTINCT chunk_id, book_id FROM chunk)
, placed AS (SELECT query_id, chunk_id, coalesce(book_id, 0) AS book_id, rank FROM pool JOIN once USING (chunk_id) WHERE rank <= 20)
, turns AS (SELECT *, row_number() OVER (PARTITION BY query_id, book_id ORDER BY rank) AS turn, min(rank) OVER (PARTITION BY query_id, book_id) AS first FROM placed)
, books AS (SELECT query_id, count(DISTINCT book_id) AS books FROM placed GROUP BY query_id)
SELECT query_id, chunk_id, book_id, place AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN books >= 2 THEN turn ELSE 0 END, CASE WHEN books >= 2 THEN first ELSE rank END) AS place FROM turns JOIN books USING (query_id)) WHERE place <= 10""")
def diversify_round_robin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fused pool of each query, spread over books in turn."""
    pool = fusion.reciprocal_rank(_result_lists(spark, sf_dir), 20)
    placed = pool.join(_once(spark, sf_dir, "chunk", "chunk_id", "book_id"), "chunk_id").withColumn("book_id", F.coalesce("book_id", F.lit(0)))
    return fusion.diversify(placed, 10).select("query_id", "chunk_id", "book_id", F.col("rank").cast("bigint").alias("rank"))


def _hybrid_lists(spark: SparkSession, sf_dir: str, fetch: int) -> list[DataFrame]:
    """Lexical list, and a vector list that asks with the embedding of the document whose id is 100 x query_id."""
    vectors, _ = _vectors(spark, sf_dir)
    asked = vectors.where("chunk_id % 100 = 0").select(F.expr("chunk_id div 100").alias("query_id"), F.col("embedding").alias("vector")).where("query_id between 1 and 8")
    hyde = vectors.where("chunk_id % 100 = 1").select(F.expr("chunk_id div 100").alias("query_id"), F.col("embedding").alias("vector")).where("query_id between 1 and 8")
    return [lexical.search(_docs(spark, sf_dir), _questions(spark), fetch), knn.search(vectors, asked, fetch), knn.search(vectors, hyde, fetch, source="hyde")]


_HYBRID = f"""{_BEST_OF.replace('LIMIT_N', '30')}
, lex AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY score, chunk_id) AS r FROM merged)
, vecs AS (SELECT vec_id // 100 AS query_id, vec_id % 100 AS part, embedding::DOUBLE[] AS a FROM embeddings WHERE vec_id % 100 IN (0, 1) AND vec_id // 100 BETWEEN 1 AND 8)
, near AS (SELECT query_id, part, vec_id AS chunk_id, row_number() OVER (PARTITION BY query_id, part ORDER BY list_distance(embedding::DOUBLE[], a), vec_id) AS r FROM embeddings, vecs)
, every AS (SELECT query_id, chunk_id, r FROM lex WHERE r <= 30 UNION ALL SELECT query_id, chunk_id, r FROM near WHERE r <= 30 AND part IN (PARTS))
, fused AS (SELECT query_id, chunk_id, round(sum(1.0::DOUBLE / (60 + r)), 12) AS score FROM every GROUP BY ALL)"""


@query(f"{_HYBRID.replace('PARTS', '0')} {_top_sql('fused', 10, 9, 'DESC')}")
def rrf_hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lexical and vector list of each question, fused."""
    return _shown(fusion.reciprocal_rank(_hybrid_lists(spark, sf_dir, 30)[:2], 10), 9)


@query(f"{_HYBRID.replace('PARTS', '0, 1')} {_top_sql('fused', 10, 9, 'DESC')}")
def rrf_hyde3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As rrf_hybrid with the list of a hypothesis as a third."""
    return _shown(fusion.reciprocal_rank(_hybrid_lists(spark, sf_dir, 30), 10), 9)


_CONTROL = ", ".join(f"'{t}'" for t in T.CONTROL_TERMS)


@query(f"WITH {_ASKED}, q AS (SELECT query_id, query FROM questions UNION ALL SELECT 1000 + book_id, title FROM book) SELECT query_id, array_to_string(list_filter([{_CONTROL}], lambda t: contains(lower(query), t)), '|') AS terms, len(list_filter([{_CONTROL}], lambda t: contains(lower(query), t))) > 0 AS is_comparison FROM q")
def detect_intent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Control terms in the questions and in all titles."""
    rows = _questions(spark).unionByName(_t(spark, sf_dir, "book").select((F.col("book_id") + 1000).alias("query_id"), F.col("title").alias("query")))
    return rows.select("query_id", F.array_join(T.control_terms(F.col("query")), "|").alias("terms"), T.is_comparison(F.col("query")).alias("is_comparison"))


@query(f"WITH {_ASKED}, {_EXPANDED_SQL} SELECT query_id, query FROM expanded")
def expand_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _questions(spark).select("query_id", T.expand_query(F.col("query")).alias("query"))


# --- text -----------------------------------------------------------------------------------------------------

_B = "[\\s\\x1c-\\x1f\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}\\x0b]"


def _strip_sql(e: str) -> str:
    return f"regexp_replace({e}, '^{_B}+|{_B}+$', '', 'g')"


def _cut_sql(e: str, n: int) -> str:
    """The longest beginning of text `e` of at most `n` bytes."""
    return f"left({e}, list_max(list_filter(range(0, {n + 1}), lambda i: strlen(left({e}, i)) <= {n})))"


_PAGES = "pages AS (SELECT DISTINCT page_id, book_id, page_num, text FROM page)"
_CHUNKS = "chunks AS (SELECT DISTINCT chunk_id, book_id, chapter_id, heading, body, chunk_order, page_start, page_end, prev_chunk_id, next_chunk_id, char_count FROM chunk)"


@query(f"WITH {_PAGES} SELECT page_id, len(parts) AS paragraphs, list_sum(list_transform(parts, lambda p: length(p)))::BIGINT AS characters, sha256(array_to_string(parts, '|')) AS digest FROM (SELECT page_id, list_filter(list_transform(string_split_regex(text, '\\n{{2,}}'), lambda p: {_strip_sql('p')}), lambda p: p <> '') AS parts FROM pages WHERE text IS NOT NULL) WHERE len(parts) > 0")
def split_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs of every page: number, characters, digest."""
    pages = _t(spark, sf_dir, "page").where("text is not null").select("page_id", X.split_paragraphs(F.col("text")).alias("parts")).where(F.size("parts") > 0)
    made = pages.select("page_id", F.size("parts").cast("bigint").alias("paragraphs"), F.aggregate("parts", F.lit(0), lambda n, p: n + F.length(p)).cast("bigint").alias("characters"), F.sha2(F.array_join("parts", "|"), 256).alias("digest"))
    return made.distinct()  # re-delivered pages give equal rows, which are smaller than their texts


def _joined_lines(e: str) -> str:
    """Lines of one character joined to the line before, as a fold over the lines."""
    lines = f"string_split({e}, chr(10))"
    step = f"CASE WHEN length(x) = 1 AND length(a) > 0 AND substr(a, length(a), 1) <> chr(10) THEN a || x ELSE a || chr(10) || x END"
    return f"list_reduce({lines}, lambda a, x: {step})"


_DECORATIVE_SQL = f"translate(text, '{X.DECORATIVE}', '')"
_CLEAN_STEP = f"regexp_replace(array_to_string(list_transform(string_split({_joined_lines(_DECORATIVE_SQL)}, chr(10)), lambda x: CASE WHEN regexp_full_match(x, '{_B}+') THEN '' ELSE x END), chr(10)), '\\n{{3,}}', chr(10) || chr(10), 'g')"
_CLEAN_SQL = _strip_sql(f"array_to_string(list_transform(string_split({_CLEAN_STEP}, chr(10)), lambda y: {_strip_sql('y')}), chr(10))")


@query(f"WITH {_PAGES} SELECT page_id, length(c) AS characters, sha256(c) AS digest FROM (SELECT page_id, {_CLEAN_SQL} AS c FROM pages WHERE text IS NOT NULL)")
def clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page cleaned: characters and digest."""
    pages = _t(spark, sf_dir, "page").where("text is not null").select("page_id", X.clean_text(F.col("text")).alias("c"))
    return pages.select("page_id", F.length("c").cast("bigint").alias("characters"), F.sha2("c", 256).alias("digest")).distinct()


_ODD = "[\\x00-\\x08\\x0e-\\x1b\\x7f-\\x{84}\\x{86}-\\x{9f}\\x{fffd}\\p{Cf}\\p{Co}]"
_SEEN = f"length(regexp_replace(t, '{_B}', '', 'g'))"
_ODDS = f"(length(t) - length(regexp_replace(t, '{_ODD}', '', 'g')))"


def _corrupt_sql(e: str) -> str:
    """Whether expression `e`, a text, looks corrupt."""
    t = f"left({e}, 4000)"
    seen = _SEEN.replace("(t,", f"({t},")
    odds = f"(length({t}) - length(regexp_replace({t}, '{_ODD}', '', 'g')))"
    return f"({seen} > 0 AND (regexp_matches({t}, '{_ODD}{{3}}') OR {odds}::DOUBLE / greatest({seen}, 1) >= 0.02))"


@query(f"WITH {_PAGES} SELECT page_id, {_SEEN} AS printable, {_ODDS} AS suspicious, round(CASE WHEN {_SEEN} > 0 THEN {_ODDS}::DOUBLE / {_SEEN} ELSE 0 END, 6) AS ratio, {_corrupt_sql('t')} AS corrupt FROM (SELECT page_id, text AS t FROM pages WHERE text IS NOT NULL)")
def suspicious_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suspicious characters of every page, and whether it looks corrupt."""
    pages = _t(spark, sf_dir, "page").where("text is not null")
    t = F.col("text")
    return pages.select("page_id", X.printable_count(t).alias("printable"), X.suspicious_count(t).alias("suspicious"), F.round(X.suspicious_ratio(t), 6).alias("ratio"), X.looks_corrupt(t).alias("corrupt")).distinct()


_FULL = f"({_strip_sql('text')} <> '')"


@query(f"""WITH {_PAGES}, p AS (SELECT book_id, page_num, coalesce(text, '') AS text FROM pages), f AS (SELECT *, {_FULL} AS full_page FROM p)
, every AS (SELECT book_id, count(*) AS pages, count(*) FILTER (full_page) AS n FROM f GROUP BY book_id)
, places AS (SELECT f.*, row_number() OVER (PARTITION BY f.book_id ORDER BY page_num) - 1 AS place, n FROM f JOIN every USING (book_id) WHERE full_page)
, looked AS (SELECT book_id, count(*) AS checked, count(*) FILTER ({_corrupt_sql('text')}) AS corrupt FROM places WHERE n <= 9 OR place <= 2 OR place BETWEEN n // 2 - 1 AND n // 2 + 1 OR place >= n - 3 GROUP BY book_id)
SELECT book_id, CASE WHEN coalesce(pages, 0) = 0 THEN 'extract_failed' WHEN n = 0 THEN 'ocr_required' WHEN corrupt >= 3 OR corrupt::DOUBLE / checked >= 0.25 THEN 'text_corrupt' ELSE 'ok' END AS quality FROM (SELECT DISTINCT book_id FROM book) LEFT JOIN every USING (book_id) LEFT JOIN looked USING (book_id)""")
def classify_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality class of every book from its sampled pages."""
    return quality.classify(_t(spark, sf_dir, "book"), _once(spark, sf_dir, "page", "page_id", "book_id", "page_num", "text"))


@query(f"""WITH {_PAGES}, m AS (SELECT book_id, max(page_num) AS total FROM pages GROUP BY book_id), s AS (SELECT DISTINCT book_id, unnest([1, greatest(1, (total + 1) // 2), total]) AS page_num FROM m)
, looked AS (SELECT book_id, count(*) AS n, count(*) FILTER ({_strip_sql("coalesce(text, '')")} = '') AS blank FROM s LEFT JOIN (SELECT book_id, page_num, text FROM pages) USING (book_id, page_num) GROUP BY book_id)
SELECT book_id, CASE WHEN blank * 2 > n THEN 'ocr-heavy' ELSE 'text' END AS extraction_mode, CASE WHEN blank * 2 > n THEN 16 ELSE 64 END AS recommended_batch_size, blank AS ocr_candidates FROM looked""")
def ocr_heavy_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.ocr_vote(_once(spark, sf_dir, "page", "page_id", "book_id", "page_num", "text"))


@query(f"""WITH {_PAGES}, w AS (SELECT a.page_id, coalesce(a.text, '') AS fast, coalesce(b.text, '') AS accurate FROM pages a LEFT JOIN pages b ON a.book_id = b.book_id AND a.page_num + 1 = b.page_num)
, l AS (SELECT *, length(regexp_replace(fast, '{_B}+', '', 'g')) AS nf, length(regexp_replace(accurate, '{_B}+', '', 'g')) AS na FROM w)
SELECT page_id, nf < 50 AS retried, sha256(CASE WHEN nf < 50 AND na > nf THEN accurate ELSE fast END) AS digest FROM l""")
def ocr_arbitrate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Choice between two readings, the next page standing in for the accurate one."""
    pages = _once(spark, sf_dir, "page", "page_id", "book_id", "page_num", "text")
    other = pages.select("book_id", (F.col("page_num") - 1).alias("page_num"), F.col("text").alias("accurate"))
    both = pages.join(other, ["book_id", "page_num"], "left")
    return both.select("page_id", quality.needs_accurate(F.col("text")).alias("retried"), F.sha2(quality.preferred_ocr(F.col("text"), F.col("accurate")), 256).alias("digest"))


# --- chapters and chunks --------------------------------------------------------------------------------------


@query(f"WITH {_PAGES} SELECT c.chapter_id, count(*) AS pages, min(page_num)::BIGINT AS first_page, max(page_num)::BIGINT AS last_page FROM chapter c JOIN pages p ON c.book_id = p.book_id AND p.page_num BETWEEN c.page_start AND c.page_end GROUP BY c.chapter_id")
def chapter_page_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of each chapter by its range."""
    pages = chunking.chapter_pages(_once(spark, sf_dir, "page", "page_id", "book_id", "page_num"), _t(spark, sf_dir, "chapter"))
    return pages.groupBy("chapter_id").agg(F.count("*").alias("pages"), F.min("page_num").cast("bigint").alias("first_page"), F.max("page_num").cast("bigint").alias("last_page"))


def _totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "page").groupBy("book_id").agg(F.max("page_num").alias("total"))


@query("""WITH t AS (SELECT book_id, max(page_num) AS total FROM page GROUP BY book_id), l AS (SELECT book_id, list(title ORDER BY chapter_order) AS titles FROM chapter GROUP BY book_id)
, r AS (SELECT book_id, total, titles, coalesce(len(titles), 0) AS n FROM t LEFT JOIN l USING (book_id))
, e AS (SELECT book_id, total, n, greatest(1, total // n) AS each_, unnest(titles) AS title, unnest(range(0, n)) AS i FROM r WHERE n > 0)
SELECT book_id, title, i::BIGINT AS chapter_order, (i * each_ + 1)::BIGINT AS page_start, (CASE WHEN i + 1 < n THEN (i + 1) * each_ ELSE total END)::BIGINT AS page_end FROM e UNION ALL SELECT book_id, '全体', 0, 1, total FROM r WHERE n = 0""")
def toc_spread_chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chapters spread evenly over each book's pages."""
    titles = _t(spark, sf_dir, "chapter").groupBy("book_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("chapter_order", "title"))), lambda x: x["title"]).alias("titles"))  # a book's chapters
    made = chunking.spread_chapters(titles, _totals(spark, sf_dir))
    return made.select("book_id", "title", *[F.col(c).cast("bigint").alias(c) for c in ("chapter_order", "page_start", "page_end")])


@query("""WITH t AS (SELECT book_id, max(page_num) AS total FROM page GROUP BY book_id)
SELECT book_id, chapter_order, page_start, coalesce(lead(page_start) OVER (PARTITION BY book_id ORDER BY chapter_order) - 1, total) AS page_end FROM chapter JOIN t USING (book_id) WHERE page_start IS NOT NULL""")
def pdf_chapter_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    starts = _t(spark, sf_dir, "chapter").where("page_start is not null").select("book_id", "title", "chapter_order", "page_start")
    return chunking.chapter_ends(starts, _totals(spark, sf_dir)).drop("title")


@query(f"WITH {_CHUNKS} SELECT chunk_id, lag(chunk_id) OVER w AS prev_chunk_id, lead(chunk_id) OVER w AS next_chunk_id FROM chunks WINDOW w AS (PARTITION BY book_id, chapter_id ORDER BY chunk_order, chunk_id)")
def chunk_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = _once(spark, sf_dir, "chunk", "chunk_id", "book_id", "chapter_id", "chunk_order")
    return chunking.link(chunks).select("chunk_id", "prev_chunk_id", "next_chunk_id")


_PARTS_SQL = f"list_filter(list_transform(string_split_regex(text, '\\n+'), lambda p: {_strip_sql('p')}), lambda p: p <> '')"
def _pack_sql(pieces: str, size: int, overlap: int) -> str:
    """Chunk bodies of the list `pieces`, as a fold; `n` counts the parts of the open chunk."""
    full = f"s.n > 0 AND s.length + length(x.parts) > {size}"
    body = "CASE WHEN s.tail <> '' THEN s.tail || chr(10) || chr(10) || s.parts ELSE s.parts END"
    step = f"""{{'parts': CASE WHEN {full} OR s.n = 0 THEN x.parts ELSE s.parts || chr(10) || chr(10) || x.parts END, 'n': CASE WHEN {full} THEN 1 ELSE s.n + 1 END, 'length': CASE WHEN {full} THEN length(x.parts) ELSE s.length + length(x.parts) END,
 'tail': CASE WHEN {full} THEN right({body}, {overlap}) ELSE s.tail END, 'bodies': CASE WHEN {full} THEN list_append(s.bodies, {body}) ELSE s.bodies END}}"""
    empty = "{'parts': '', 'n': 0::BIGINT, 'length': 0::BIGINT, 'tail': '', 'bodies': []::VARCHAR[]}"
    items = f"list_transform({pieces}, lambda p: {{'parts': p, 'n': 0::BIGINT, 'length': 0::BIGINT, 'tail': '', 'bodies': []::VARCHAR[]}})"
    return f"list_transform([list_reduce({items}, lambda s, x: {step}, {empty})], lambda s: CASE WHEN s.n > 0 THEN list_append(s.bodies, {body}) ELSE s.bodies END)[1]"


def _force_sql(p: str, size: int) -> str:
    """Parts of a long paragraph."""
    pieces = f"list_transform(regexp_extract_all({p}, '[^。？！\n]*[。？！\n]|[^。？！\n]+$'), lambda y: {{'now': y, 'done': []::VARCHAR[]}})"
    step = f"CASE WHEN length(a.now) + length(b.now) > {size} AND a.now <> '' THEN {{'now': b.now, 'done': list_append(a.done, {_strip_sql('a.now')})}} ELSE {{'now': a.now || b.now, 'done': a.done}} END"
    return f"list_transform([list_reduce({pieces}, lambda a, b: {step}, {{'now': '', 'done': []::VARCHAR[]}})], lambda a: CASE WHEN {_strip_sql('a.now')} <> '' THEN list_append(a.done, {_strip_sql('a.now')}) ELSE a.done END)[1]"


@query(f"""WITH b AS (SELECT doc_id, {_pack_sql(_PARTS_SQL, 200, 40)} AS bodies FROM documents WHERE text IS NOT NULL)
SELECT doc_id, chunk_order::BIGINT AS chunk_order, length(body) AS char_count, sha256(body) AS digest FROM (SELECT doc_id, unnest(bodies) AS body, unnest(range(0, len(bodies))) AS chunk_order FROM b)""")
def chunk_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of every document packed into chunks of 200 with an overlap of 40."""
    docs = _t(spark, sf_dir, "documents").where("text is not null")
    pieces = F.filter(F.transform(F.split("text", "\n+"), X.strip), lambda p: p != "")
    out = docs.select("doc_id", F.posexplode(chunking.pack(pieces, 200, 40)).alias("chunk_order", "body"))
    return out.select("doc_id", F.col("chunk_order").cast("bigint").alias("chunk_order"), F.length("body").cast("bigint").alias("char_count"), F.sha2("body", 256).alias("digest"))


@query(f"""WITH {_PAGES}
, j AS (SELECT c.book_id, c.chapter_order, c.title, p.page_num, coalesce(p.text, '') AS text FROM chapter c JOIN pages p ON c.book_id = p.book_id AND p.page_num BETWEEN c.page_start AND c.page_end)
, w AS (SELECT book_id, chapter_order, min(page_num) AS page_start, max(page_num) AS page_end, string_agg(text, chr(10) || chr(10) ORDER BY page_num, text) AS whole FROM j GROUP BY book_id, chapter_order, title)
, q AS (SELECT *, flatten(list_transform(list_filter(list_transform(string_split_regex(whole, '\\n{{2,}}'), lambda p: {_strip_sql('p')}), lambda p: p <> ''), lambda p: CASE WHEN length(p) > 1000 THEN {_force_sql('p', 500)} ELSE [p] END)) AS pieces FROM w)
, b AS (SELECT *, {_pack_sql('pieces', 500, 100)} AS bodies FROM q)
SELECT book_id, chapter_order, chunk_order::BIGINT AS chunk_order, page_start, page_end, length(body) AS char_count, sha256(body) AS digest FROM (SELECT *, unnest(bodies) AS body, unnest(range(0, len(bodies))) AS chunk_order FROM b)""")
def chunk_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every book cut into chunks by its chapters, with forced splits of long paragraphs."""
    made = chunking.chunk_pages(_once(spark, sf_dir, "page", "page_id", "book_id", "page_num", "text"), _t(spark, sf_dir, "chapter"))
    return made.select("book_id", "chapter_order", F.col("chunk_order").cast("bigint").alias("chunk_order"), "page_start", "page_end", F.col("char_count").cast("bigint").alias("char_count"), F.sha2("body", 256).alias("digest"))


# --- context --------------------------------------------------------------------------------------------------


def _details(spark: SparkSession, sf_dir: str, limit: int) -> tuple[DataFrame, DataFrame]:
    ranked = fusion.reciprocal_rank(_result_lists(spark, sf_dir), limit)
    chunk = _once(spark, sf_dir, "chunk", "chunk_id", "book_id", "chapter_id", "heading", "body", "page_start", "page_end", "prev_chunk_id", "next_chunk_id")
    return context.with_details(ranked, chunk, _t(spark, sf_dir, "book"), _t(spark, sf_dir, "chapter")), chunk


_DETAILS = f"""{_LISTS}, {_CHUNKS}
, ranked AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM fused)
, details AS (SELECT r.query_id, r.rank, k.*, b.title AS book_title, c.title AS chapter_title FROM ranked r JOIN chunks k USING (chunk_id) LEFT JOIN book b USING (book_id) LEFT JOIN chapter c USING (chapter_id) WHERE rank <= 10)"""


@query(f"""WITH {_DETAILS}
, sides AS (SELECT query_id, rank, chapter_id, 0 AS side, prev_chunk_id AS n FROM details UNION ALL SELECT query_id, rank, chapter_id, 1, next_chunk_id FROM details)
, free AS (SELECT s.* FROM sides s JOIN chunks k ON k.chunk_id = s.n AND k.chapter_id = s.chapter_id WHERE NOT EXISTS (SELECT 1 FROM details d WHERE d.query_id = s.query_id AND d.chunk_id = s.n))
, claimed AS (SELECT *, row_number() OVER (PARTITION BY query_id, n ORDER BY rank, side) AS claim FROM free)
SELECT d.query_id, d.chunk_id, max(CASE WHEN side = 0 THEN n END) AS before, max(CASE WHEN side = 1 THEN n END) AS after FROM details d LEFT JOIN claimed c ON c.query_id = d.query_id AND c.rank = d.rank AND claim = 1 GROUP BY ALL""")
def adjacent_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbours that each result brings along, by id."""
    details, chunk = _details(spark, sf_dir, 10)
    named = context.with_neighbours(details, chunk.withColumn("body", F.col("chunk_id").cast("string")))
    return named.select("query_id", "chunk_id", F.col("prev_body").cast("bigint").alias("before"), F.col("next_body").cast("bigint").alias("after"))


_CLIPPED = f"CASE WHEN strlen(body) > 500 THEN {_cut_sql('body', 500)} || '...' ELSE body END"
_ENTRY = """'[' || rank || '] ' || coalesce('Book: ' || book_title, '') || coalesce(' | Chapter: ' || chapter_title, '') || CASE WHEN page_start IS NOT NULL AND page_end IS NOT NULL THEN ' | Pages: ' || page_start || '-' || page_end ELSE '' END || chr(10) || coalesce(BODY, '') || chr(10) || '---' || chr(10)"""


@query(f"""WITH {_DETAILS}, e AS (SELECT query_id, rank, strlen({_ENTRY.replace('BODY', _CLIPPED)}) AS size FROM details)
, s AS (SELECT *, sum(size) OVER (PARTITION BY query_id ORDER BY rank) AS running, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS first FROM e)
SELECT query_id, count(*) AS kept, sum(size)::BIGINT AS bytes FROM s WHERE first = 1 OR running <= 3000 GROUP BY query_id""")
def prompt_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Excerpts of at most 500 bytes of each body that fit 3,000 bytes for each query."""
    details, _ = _details(spark, sf_dir, 10)
    kept = context.within_budget(context.prompt_entries(details, 500), 3000)
    return kept.groupBy("query_id").agg(F.count("*").alias("kept"), F.sum(F.octet_length("entry")).cast("bigint").alias("bytes"))


@query(f"""WITH {_DETAILS} SELECT query_id, rank, '[' || rank || '] ' || concat_ws(', ', coalesce(book_title, 'Unknown'), CASE WHEN chapter_title <> '' THEN chapter_title END, CASE WHEN page_start IS NOT NULL AND page_end IS NOT NULL THEN 'pp.' || page_start || '-' || page_end END) AS source_line FROM details""")
def format_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    details, _ = _details(spark, sf_dir, 10)
    return context.sources(details).select("query_id", F.col("rank").cast("bigint").alias("rank"), "source_line")


_WIDE = "concat_ws(chr(10) || chr(10), prev_body, body, next_body)"
_LONG_ENTRY = f"""'[' || rank || '] ' || coalesce('Book: ' || book_title, '') || coalesce(' | Chapter: ' || chapter_title, '') || CASE WHEN page_start IS NOT NULL AND page_end IS NOT NULL THEN ' | Pages: ' || page_start || '-' || page_end ELSE '' END || chr(10) || CASE WHEN strlen(wide) > 1200 THEN {_cut_sql('wide', 1200)} || '...' ELSE coalesce(wide, '') END || chr(10) || '---' || chr(10)"""


@query(f"""WITH {_DETAILS}
, sides AS (SELECT query_id, rank, chapter_id, 0 AS side, prev_chunk_id AS n FROM details UNION ALL SELECT query_id, rank, chapter_id, 1, next_chunk_id FROM details)
, free AS (SELECT s.*, k.body AS found FROM sides s JOIN chunks k ON k.chunk_id = s.n AND k.chapter_id = s.chapter_id WHERE NOT EXISTS (SELECT 1 FROM details d WHERE d.query_id = s.query_id AND d.chunk_id = s.n))
, claimed AS (SELECT *, row_number() OVER (PARTITION BY query_id, n ORDER BY rank, side) AS claim FROM free)
, near AS (SELECT query_id, rank, max(CASE WHEN side = 0 THEN found END) AS prev_body, max(CASE WHEN side = 1 THEN found END) AS next_body FROM claimed WHERE claim = 1 GROUP BY ALL)
, w AS (SELECT *, {_WIDE} AS wide FROM details LEFT JOIN near USING (query_id, rank)), e AS (SELECT query_id, rank, {_LONG_ENTRY} AS entry FROM w)
, b AS (SELECT *, sum(strlen(entry)) OVER (PARTITION BY query_id ORDER BY rank) AS running, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS first FROM e)
SELECT query_id, '{context.SYSTEM_PROMPT.replace("'", "''")}' AS system, 'Excerpts:' || chr(10) || '---' || chr(10) || string_agg(entry, '' ORDER BY rank) || chr(10) || 'Question: question ' || query_id AS user FROM b WHERE first = 1 OR running <= 3000 GROUP BY query_id""")
def prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole prompts with neighbouring chunks, for every query of search_result."""
    details, chunk = _details(spark, sf_dir, 10)
    asked = details.select("query_id").distinct().withColumn("query", F.concat(F.lit("question "), F.col("query_id").cast("string")))
    return context.prompts(context.with_neighbours(details, chunk), asked, 3000, 1200, True)


# --- catalogue ------------------------------------------------------------------------------------------------


@query("""WITH known AS (SELECT source_path, file_hash FROM book WHERE book_id % 3 = 0), fresh AS (SELECT b.book_id, b.source_path, b.file_hash FROM book b WHERE NOT EXISTS (SELECT 1 FROM known k WHERE k.source_path = b.source_path) AND NOT EXISTS (SELECT 1 FROM known k WHERE k.file_hash = b.file_hash))
SELECT book_id, source_path FROM fresh f WHERE source_path = (SELECT min(source_path) FROM fresh g WHERE g.file_hash = f.file_hash)""")
def dedup_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Books to ingest if every third were known: by path, then by content, one of equal contents."""
    book = _t(spark, sf_dir, "book").select("book_id", "source_path", "file_hash")
    return catalog.new_files(book, book.where("book_id % 3 = 0")).select("book_id", "source_path")


@query("SELECT any_value(sha) AS file_hash, count(*) AS copies, min(doc_id) AS doc_id FROM (SELECT doc_id, sha256(text) AS sha FROM documents WHERE text IS NOT NULL) GROUP BY sha")
def dedup_by_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of every document's text, with its copies and first id."""
    hashed = _t(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.sha2("text", 256).alias("file_hash"))
    return hashed.groupBy("file_hash").agg(F.count("*").alias("copies"), F.min("doc_id").alias("doc_id"))


@query("SELECT DISTINCT chunk_id, book_id FROM chunk c WHERE NOT EXISTS (SELECT 1 FROM chunk_vec v WHERE v.chunk_id = c.chunk_id AND v.embedding IS NOT NULL)")
def missing_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.without_vectors(_once(spark, sf_dir, "chunk", "chunk_id", "book_id"), _t(spark, sf_dir, "chunk_vec"))


@query(f"""WITH {_CHUNKS}, gone AS (SELECT chunk_id FROM chunks WHERE book_id % 5 = 0)
SELECT 'book' AS name, count(*) AS n FROM book WHERE book_id % 5 <> 0 UNION ALL SELECT 'chapter', count(*) FROM chapter WHERE book_id % 5 <> 0 UNION ALL SELECT 'chunk', count(*) FROM chunks WHERE book_id % 5 <> 0
UNION ALL SELECT 'chunk_vec', count(DISTINCT chunk_id) FROM chunk_vec WHERE chunk_id NOT IN (SELECT chunk_id FROM gone)
UNION ALL SELECT 'links', count(*) FROM chunks WHERE book_id % 5 <> 0 AND prev_chunk_id IS NOT NULL AND prev_chunk_id NOT IN (SELECT chunk_id FROM gone)""")
def delete_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows left in each table after every fifth book is deleted, and links that still hold."""
    tables = {"book": _t(spark, sf_dir, "book"), "chapter": _t(spark, sf_dir, "chapter"), "chunk": _once(spark, sf_dir, "chunk", "chunk_id", "book_id", "prev_chunk_id", "next_chunk_id"), "chunk_vec": _once(spark, sf_dir, "chunk_vec", "chunk_id")}
    left = catalog.delete_books(tables, tables["book"].where("book_id % 5 = 0"))
    counts = [left[name].agg(F.lit(name).alias("name"), F.count("*").alias("n")) for name in tables]
    counts.append(left["chunk"].where("prev_chunk_id is not null").agg(F.lit("links").alias("name"), F.count("*").alias("n")))
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out


@query("""SELECT vec_id AS chunk_id, round(list_sum(list_transform(CASE WHEN vec_id % 7 = 0 THEN list_transform(embedding::DOUBLE[], lambda x: -x) ELSE embedding::DOUBLE[] END, lambda x: x)), 4) AS total FROM embeddings""")
def upsert_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every seventh vector replaced by its negative."""
    stored = _vectors(spark, sf_dir)[0].select("chunk_id", "embedding")
    new = stored.where("chunk_id % 7 = 0").withColumn("embedding", F.transform("embedding", lambda x: -x))
    return knn.upsert(stored, new).select("chunk_id", F.round(F.aggregate("embedding", F.lit(0.0), lambda n, x: n + x.cast("double")), 4).alias("total"))


@query("SELECT b.book_id, b.title, count(c.chunk_id) AS chunks FROM book b LEFT JOIN (SELECT DISTINCT chunk_id, book_id FROM chunk) c USING (book_id) GROUP BY ALL")
def book_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.book_statistics(_t(spark, sf_dir, "book"), _once(spark, sf_dir, "chunk", "chunk_id", "book_id"))


@query("""WITH h AS (SELECT DISTINCT chunk_id FROM chunk_vec WHERE embedding IS NOT NULL), c AS (SELECT DISTINCT chunk_id FROM chunk)
SELECT (SELECT count(*) FROM book) AS books, (SELECT count(*) FROM chapter) AS chapters, count(*) AS chunks, count(h.chunk_id) AS embedded, count(*) - count(h.chunk_id) AS missing FROM c LEFT JOIN h ON h.chunk_id = c.chunk_id""")
def library_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.library_statistics(_t(spark, sf_dir, "book"), _t(spark, sf_dir, "chapter"), _once(spark, sf_dir, "chunk", "chunk_id"), _t(spark, sf_dir, "chunk_vec"))


@query(f"WITH {_CHUNKS} SELECT b.book_id, b.title AS book_title, chapter_id, chunk_id, heading, sha256(body) AS digest, char_count, chunk_order FROM book b JOIN chunks USING (book_id)")
def export_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunk = _t(spark, sf_dir, "chunk").select("chunk_id", "book_id", "chapter_id", "heading", F.sha2("body", 256).alias("body"), "char_count", "chunk_order").distinct()
    return catalog.export_rows(_t(spark, sf_dir, "book"), chunk).withColumnRenamed("body", "digest")


@query(f"SELECT DISTINCT chunk_id, {_cut_sql('body', 300)} AS preview FROM chunk WHERE body IS NOT NULL")
def previews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First 300 bytes of every chunk, never part of a character."""
    chunks = _t(spark, sf_dir, "chunk").where("body is not null")
    return chunks.select("chunk_id", exchange.preview(F.col("body"), 300).alias("preview")).distinct()


_COUNTERS = ("ocr_pages", "ocr_retries", "ocr_ms", "ocr_fast_pages", "ocr_retry_pages", "ocr_fast_ms", "ocr_retry_ms")


@query(f"SELECT book_id, {', '.join(f'coalesce(sum({c}), 0)::BIGINT AS {c}' for c in _COUNTERS)} FROM (SELECT DISTINCT batch_id, book_id, {', '.join(_COUNTERS)} FROM extract_stats) GROUP BY book_id")
def ocr_stats_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.stats_rollup(_once(spark, sf_dir, "extract_stats", "batch_id", "book_id", *_COUNTERS))


@query("SELECT book_id, any_value(title) AS title, any_value(CASE WHEN title IS NULL OR title = '' OR (book_format = 'epub' AND (trim(lower(title)) IN ('', 'unknown', 'untitled') OR contains(lower(title), '(blank)'))) THEN regexp_replace(regexp_extract(source_path, '([^/]*)$', 1), '(.)\\.[^.]*$', '\\1') ELSE title END) AS shown, any_value(regexp_replace(regexp_extract(source_path, '([^/]*)$', 1), '(.)\\.[^.]*$', '\\1')) AS stem, any_value(book_format) AS kind FROM book GROUP BY book_id")
def title_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles with the file's stem where there is none, and format by extension."""
    path = F.col("source_path")
    return _t(spark, sf_dir, "book").select("book_id", "title", X.title_or_stem(F.col("title"), path, F.col("book_format")).alias("shown"), X.file_stem(path).alias("stem"), X.detect_format(path).alias("kind"))


# --- evaluation and orchestration -----------------------------------------------------------------------------

_EXPECTED = "expected AS (SELECT query_id, list(DISTINCT title) AS titles FROM (SELECT r.query_id, b.title, r.rank FROM ranked r JOIN chunks USING (chunk_id) JOIN book b USING (book_id) WHERE rank IN (1, 7)) GROUP BY query_id)"


def _expected(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Results with titles, and as expected titles those at rank 1 and 7."""
    details, _ = _details(spark, sf_dir, 10)
    return details, details.where("rank in (1, 7) and book_title is not null").groupBy("query_id").agg(F.collect_set("book_title").alias("titles"))


@query(f"WITH {_DETAILS}, {_EXPECTED}, found AS (SELECT query_id, list(DISTINCT book_title) AS found FROM details WHERE rank <= 5 GROUP BY query_id) SELECT query_id, len(list_filter(titles, lambda t: NOT len(list_filter(found, lambda f: contains(f, t))) > 0)) = 0 AS hit FROM expected LEFT JOIN found USING (query_id)")
def topk_hit_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    details, expected = _expected(spark, sf_dir)
    return evaluate.hit_rate(details, expected)


@query(f"WITH {_DETAILS}, {_EXPECTED}, found AS (SELECT query_id, list(DISTINCT book_title) AS found FROM details WHERE rank <= 5 GROUP BY query_id) SELECT query_id, round(len(list_filter(titles, lambda t: len(list_filter(found, lambda f: contains(f, t))) > 0))::DOUBLE / len(titles) * 100, 1) AS coverage FROM expected LEFT JOIN found USING (query_id)")
def source_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    details, expected = _expected(spark, sf_dir)
    return evaluate.source_coverage(details.where("rank <= 5"), expected)


@query("SELECT event_type, quantile_disc(value, 0.5) AS median_value, quantile_disc(value, 0.95) AS p95_value FROM events WHERE value > 0 GROUP BY event_type")
def latency_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest-rank percentiles of the events' values by type."""
    return _t(spark, sf_dir, "events").where("value > 0").groupBy("event_type").agg(evaluate.nearest_rank("value", 0.5).alias("median_value"), evaluate.nearest_rank("value", 0.95).alias("p95_value"))


_JOBS = "jobs AS (SELECT DISTINCT job_id, book_id, status, quality, chunks_written, chunk_ms FROM chunk_response)"


@query(f"""WITH {_JOBS}, s AS (SELECT book_id, sum(ocr_pages) AS ocr_pages, sum(ocr_ms) AS ocr_ms FROM (SELECT DISTINCT batch_id, book_id, ocr_pages, ocr_ms FROM extract_stats) GROUP BY book_id), p AS (SELECT j.*, coalesce(ocr_pages, 0) AS ocr_pages, coalesce(ocr_ms, 0) AS ocr_ms FROM jobs j LEFT JOIN s USING (book_id))
SELECT count(*) AS books, count(*) FILTER (status = 'ok') AS completed_books, count(*) FILTER (status = 'ok' AND chunks_written > 0) AS effective_books, sum(chunks_written) FILTER (status = 'ok')::BIGINT AS total_chunks, sum(chunk_ms) FILTER (status = 'ok')::BIGINT AS total_chunk_ms, sum(ocr_pages) FILTER (status = 'ok')::BIGINT AS total_ocr_pages, sum(ocr_ms) FILTER (status = 'ok')::BIGINT AS total_ocr_ms,
round(median(coalesce(chunk_ms, 0)) FILTER (status = 'ok'), 3) AS median_chunk_ms, round(median(ocr_ms) FILTER (status = 'ok'), 3) AS median_ocr_ms FROM p""")
def ingest_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals and medians over all ingest jobs."""
    jobs = _once(spark, sf_dir, "chunk_response", "job_id", "book_id", "status", "quality", "chunks_written", "chunk_ms")
    stats = evaluate.stats_rollup(_once(spark, sf_dir, "extract_stats", "batch_id", "book_id", *_COUNTERS)).select("book_id", "ocr_pages", "ocr_ms")
    rows = jobs.join(stats, "book_id", "left").select(F.when(F.col("status") == "ok", "completed").otherwise(F.col("status")).alias("status"), F.col("chunks_written").alias("chunks"), F.lit("hashing").alias("embed_model"), F.col("chunk_ms").alias("total_ms"), "chunk_ms", F.coalesce("ocr_pages", F.lit(0)).alias("ocr_pages"), F.coalesce("ocr_ms", F.lit(0)).alias("ocr_ms"))
    made = evaluate.ingest_summary(rows)
    return made.select("books", "completed_books", "effective_books", "total_chunks", "total_chunk_ms", "total_ocr_pages", "total_ocr_ms", F.round("median_chunk_ms", 3).alias("median_chunk_ms"), F.round("median_ocr_ms", 3).alias("median_ocr_ms"))


@query("""WITH j AS (SELECT job_id, CASE status WHEN 'ok' THEN 'completed' WHEN 'error' THEN 'failed' ELSE status END AS status, min(finished_at) AS changed_at FROM chunk_response GROUP BY ALL)
SELECT job_id, CASE WHEN status = 'failed' THEN 'keep_failed' WHEN status IS NULL OR status NOT IN ('completed', 'failed') THEN 'protect' WHEN epoch_us(TIMESTAMPTZ '2026-01-01 00:00:00+00') - epoch_us(changed_at) < 168::BIGINT * 3600 * 1000000 THEN 'recent' ELSE 'remove' END AS outcome FROM j""")
def prune_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a clean-up on the first of 2026 would do with each job."""
    status = F.when(F.col("status") == "ok", "completed").when(F.col("status") == "error", "failed").otherwise(F.col("status"))
    jobs = _t(spark, sf_dir, "chunk_response").groupBy("job_id", status.alias("status")).agg(F.min("finished_at").alias("changed_at"))
    return orchestrate.prune(jobs, F.lit("2026-01-01 00:00:00+00:00").cast("timestamp")).select("job_id", "outcome")


@query("""WITH r AS (SELECT book_id, page_count, unnest(range(0, (page_count + 63) // 64)) AS batch FROM book WHERE page_count > 0), e AS (SELECT book_id, batch, batch * 64 + 1 AS page_start, least(batch * 64 + 64, page_count) AS page_end FROM r)
SELECT book_id, batch::BIGINT AS batch, page_start::BIGINT AS page_start, page_end::BIGINT AS page_end FROM e WHERE NOT EXISTS (SELECT 1 FROM extract_stats s WHERE s.book_id = e.book_id AND s.page_start = e.page_start AND s.page_end = e.page_end)""")
def batch_ranges_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page batches of each book without statistics."""
    books = _t(spark, sf_dir, "book").select("book_id", "page_count", F.lit(64).alias("batch_size"))
    left = orchestrate.pending(orchestrate.batch_ranges(books), _t(spark, sf_dir, "extract_stats"))
    return left.select("book_id", *[F.col(c).cast("bigint").alias(c) for c in ("batch", "page_start", "page_end")])


_GIB = 1 << 30


@query(f"""WITH g AS (SELECT job_id, chunk_ms, 1 + abs(book_id) % 10 AS cores, (4 + book_id % 8)::BIGINT * {_GIB} AS total, (book_id % 16)::BIGINT * 100 * 1048576 AS free FROM (SELECT DISTINCT job_id, book_id, chunk_ms FROM chunk_response))
, t AS (SELECT *, CASE WHEN chunk_ms < 1500 THEN 1 WHEN chunk_ms < 5000 THEN 2 WHEN chunk_ms < 10000 THEN 4 WHEN chunk_ms < 20000 THEN 6 ELSE 8 END AS target, CASE WHEN cores <= 4 THEN 4 WHEN cores <= 7 THEN 6 ELSE 8 END AS tier FROM g)
, c AS (SELECT *, greatest(1, CASE WHEN free > 0 AND free < 256 * 1048576 THEN 1 WHEN total < 8 * {_GIB}::BIGINT THEN least(tier, 2) ELSE tier END) AS cap FROM t)
SELECT job_id, target::BIGINT AS target, cap::BIGINT AS cap, list_max(list_filter([1, 2, 4, 6, 8], lambda x: x <= greatest(1, least(target, cap))))::BIGINT AS workers FROM c""")
def worker_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Workers for hosts derived from the jobs, by batch time, cores and memory."""
    rows = _once(spark, sf_dir, "chunk_response", "job_id", "book_id", "chunk_ms")
    b = F.col("book_id")
    cap = orchestrate.host_cap(1 + F.abs(b) % 10, (4 + b % 8) * _GIB, (b % 16) * 100 * orchestrate.MIB, F.lit(8))
    target = orchestrate.target_workers(F.coalesce("chunk_ms", F.lit(1 << 40)))
    return rows.select("job_id", target.cast("bigint").alias("target"), cap.cast("bigint").alias("cap"), orchestrate.planned_workers(F.coalesce("chunk_ms", F.lit(1 << 40)), cap).cast("bigint").alias("workers"))


@query("SELECT user_id, event_id, done FROM (SELECT user_id, event_id, done, lag(done, 1, 0) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS done FROM events)) WHERE done // 10 > before // 10")
def progress_crossings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events at which a user's running count passes a multiple of ten."""
    running = _t(spark, sf_dir, "events").select(F.col("user_id").alias("job_id"), F.col("event_id").alias("batch")).withColumn("done", F.row_number().over(Window.partitionBy("job_id").orderBy("batch")).cast("bigint"))
    return chunking.progress_crossings(running, 10).select(F.col("job_id").alias("user_id"), F.col("batch").alias("event_id"), "done")


@query("SELECT book_id, chunks, missing, round(CASE WHEN chunks > 0 THEN missing::DOUBLE / chunks ELSE 0 END, 6) AS failed_ratio, coalesce(missing::DOUBLE / nullif(chunks, 0), 0) > 0.5 AS warn FROM (SELECT book_id, count(*) AS chunks, count(*) FILTER (v.chunk_id IS NULL) AS missing FROM (SELECT DISTINCT chunk_id, book_id FROM chunk) c LEFT JOIN (SELECT DISTINCT chunk_id FROM chunk_vec WHERE embedding IS NOT NULL) v ON v.chunk_id = c.chunk_id GROUP BY book_id)")
def embedding_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of each book's chunks that have no vector."""
    have = _t(spark, sf_dir, "chunk_vec").where("embedding is not null").select("chunk_id").distinct().withColumn("has", F.lit(1))
    counts = _once(spark, sf_dir, "chunk", "chunk_id", "book_id").join(have, "chunk_id", "left").groupBy("book_id").agg(F.count("*").alias("total"), F.count_if(F.col("has").isNull()).alias("failed"))
    made = orchestrate.embedding_failures(counts)
    return made.select("book_id", F.col("total").alias("chunks"), F.col("failed").alias("missing"), F.round("failed_ratio", 6).alias("failed_ratio"), "warn")


@query(f"SELECT 'word' AS index_name, count(*) AS terms, sum(c)::BIGINT AS postings, sum(tf)::BIGINT AS occurrences FROM (SELECT term, count(DISTINCT doc_id) AS c, count(*) AS tf FROM (SELECT doc_id, unnest(list_concat({_words_sql("coalesce(heading, '')")}, {_words_sql("coalesce(text, '')")})) AS term FROM documents) GROUP BY term)")
def word_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size of the word index over all documents, headings included."""
    counts = lexical.word_postings(_docs(spark, sf_dir)).groupBy("term").agg(F.count("*").alias("c"), F.sum("tf").alias("tf"))
    return counts.agg(F.lit("word").alias("index_name"), F.count("*").alias("terms"), F.sum("c").alias("postings"), F.sum("tf").alias("occurrences"))


def _trigrams_sql(e: str) -> str:
    return f"list_transform(range(1, greatest(length({e}) - 1, 1)), lambda i: substr(lower({e}), i, 3))"


@query(f"WITH {_CHUNKS}, t AS (SELECT DISTINCT chunk_id, unnest(list_concat({_trigrams_sql("coalesce(heading, '')")}, {_trigrams_sql("coalesce(body, '')")})) AS term FROM chunks) SELECT 'trigram' AS index_name, count(*) AS terms, sum(c)::BIGINT AS postings FROM (SELECT term, count(*) AS c FROM t GROUP BY term)")
def trigram_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size of the trigram index over all chunks."""
    chunks = _once(spark, sf_dir, "chunk", "chunk_id", "heading", "body")
    counts = lexical.trigram_postings(chunks).groupBy("term").agg(F.count("*").alias("c"))
    return counts.agg(F.lit("trigram").alias("index_name"), F.count("*").alias("terms"), F.sum("c").alias("postings"))
