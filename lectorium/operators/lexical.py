"""Lexical retrieval: postings of words and trigrams, BM25, and the merge of both indexes.

Scores are negative, lower is better. All functions take many queries at once: (query_id, query).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectorium.functions import terms as T
from lectorium.schema import BM25_B, BM25_K1, BM25_LEAST_IDF
from lectorium.session import broadcast_if_small


#: Places to which scores are rounded before they are ranked: sums of doubles differ in their last digits from run to run.
SCORE_PLACES = 9
#: Distinct terms of all questions that may stand in the plan itself.
LITERAL_TERMS = 1_000


def _both(df: DataFrame, heading: str | None, body: str, of) -> Column:
    """Terms of heading and body, each by itself."""
    text = of(F.coalesce(F.col(body), F.lit("")))
    return F.concat(of(F.coalesce(F.col(heading), F.lit(""))), text) if heading else text


def _each_term(rows: DataFrame) -> DataFrame:
    """A row for each term. An outer explode, as for others a filter on the array's size is inferred and pushed down,
    which would work out the terms twice."""
    return rows.select("chunk_id", "length", F.explode_outer("terms").alias("term")).where("term is not null")


def word_postings(df: DataFrame, id_column: str = "chunk_id", heading: str | None = "heading", body: str = "body") -> DataFrame:
    """(term, chunk_id, tf, length): the word index. Partial counts are made before the shuffle."""
    rows = df.select(F.col(id_column).alias("chunk_id"), _both(df, heading, body, T.words).alias("terms"))
    rows = rows.withColumn("length", F.size("terms").cast("bigint"))
    return _each_term(rows).groupBy("term", "chunk_id", "length").agg(F.count("*").alias("tf")).select("term", "chunk_id", "tf", "length")


def trigram_postings(df: DataFrame, id_column: str = "chunk_id", heading: str | None = "heading", body: str = "body") -> DataFrame:
    """(term, chunk_id, tf, length): the trigram index."""
    rows = df.select(F.col(id_column).alias("chunk_id"), _both(df, heading, body, T.trigrams).alias("terms"))
    rows = rows.withColumn("length", F.size("terms").cast("bigint"))
    return _each_term(rows).groupBy("term", "chunk_id", "length").agg(F.count("*").alias("tf")).select("term", "chunk_id", "tf", "length")


def _top(scored: DataFrame, source: str, limit: int) -> DataFrame:
    """Ranked list of the `limit` lowest scores of each query; ties go to the smaller chunk_id."""
    order = Window.partitionBy("query_id").orderBy("score", "chunk_id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit).select("query_id", F.lit(source).alias("source"), "chunk_id", "rank", "score")


def _score(f: Column, n: Column, rows: Column, length: Column, mean: Column) -> Column:
    idf = F.log((rows - n + 0.5) / (n + 0.5))
    idf = F.when(idf <= 0, F.lit(BM25_LEAST_IDF)).otherwise(idf)
    return -idf * f * (BM25_K1 + 1) / (f + BM25_K1 * (1 - BM25_B + BM25_B * length / mean))


def _kept_books(scored: DataFrame, books: DataFrame | None) -> DataFrame:
    """Only chunks of the asked book, taken out before the limit; statistics stay those of all rows."""
    return scored if books is None else scored.join(books.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_semi")


def word_search(df: DataFrame, queries: DataFrame, limit: int, id_column: str = "chunk_id", heading: str | None = "heading", body: str = "body", books: DataFrame | None = None) -> DataFrame:
    """Best chunks by BM25 over words, any of which may match; a repeated query term counts once for each time.

    Without a stored index: the texts are read once, and only postings of asked terms are shuffled.
    `books` (query_id, chunk_id) restricts a query to chunks.
    """
    asked = queries.select("query_id", F.explode(T.query_segments(F.col("query"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("times"))
    rows = df.select(F.col(id_column).alias("chunk_id"), _both(df, heading, body, T.words).alias("terms"))
    rows = rows.withColumn("length", F.size("terms").cast("bigint"))
    corpus = rows.agg(F.count("*").alias("rows"), F.avg("length").alias("mean"))
    # up to LITERAL_TERMS asked terms are sought within the arrays; more are joined
    literal = [r["term"] for r in asked.select("term").distinct().limit(LITERAL_TERMS + 1).collect()]
    if len(literal) <= LITERAL_TERMS:
        found = _each_term(rows.withColumn("terms", F.filter("terms", lambda t: t.isin(literal))))
    else:
        found = _each_term(rows).join(asked.select("term").distinct(), "term", "left_semi")
    postings = found.groupBy("term", "chunk_id", "length").agg(F.count("*").alias("tf"))
    return search_postings(postings, corpus, asked, limit, books, "word")


def search_postings(postings: DataFrame, corpus: DataFrame, asked: DataFrame, limit: int, books: DataFrame | None = None, source: str = "word") -> DataFrame:
    """As word_search, over a stored index: `postings` (term, chunk_id, tf, length), `corpus` one row (rows, mean),
    `asked` (query_id, term, times)."""
    n = postings.groupBy("term").agg(F.count("*").alias("n"))
    weights = asked.join(n, "term")
    hits = postings.join(weights, "term").crossJoin(F.broadcast(corpus))  # one row
    score = _score(F.col("tf"), F.col("n"), F.col("rows"), F.col("length"), F.col("mean"))
    scored = hits.groupBy("query_id", "chunk_id").agg(F.round(F.sum(score * F.col("times")), SCORE_PLACES).alias("score"))
    return _top(_kept_books(scored, books), source, limit)


def corpus_statistics(postings: DataFrame, documents: DataFrame, id_column: str = "chunk_id") -> DataFrame:
    """(rows, mean) of a stored index; documents without any term count as rows of length 0."""
    total = postings.select("chunk_id", "length").distinct().agg(F.sum("length").alias("total"))
    rows = documents.agg(F.count(F.col(id_column)).alias("rows"))
    return rows.crossJoin(F.broadcast(total)).select("rows", (F.coalesce("total", F.lit(0)) / F.col("rows")).alias("mean"))


def _lengths(postings: DataFrame) -> DataFrame:
    """One row: the sum of the lengths of all indexed rows."""
    return postings.select("chunk_id", "length").distinct().agg(F.coalesce(F.sum("length"), F.lit(0)).cast("double").alias("total"))


def trigram_search(df: DataFrame, queries: DataFrame, limit: int, id_column: str = "chunk_id", heading: str | None = "heading", body: str = "body", books: DataFrame | None = None, corpus: DataFrame | None = None) -> DataFrame:
    """Best chunks by BM25 over substrings of three characters or more, all of which must match.

    Queries without such a term find nothing. Up to BROADCAST_ROWS terms are sent to the texts (they are few
    against the texts; more meet them partition by partition), and a chunk is scored only if it holds all terms. With
    `corpus` (rows, mean), `df` may be cut to chunks among which all matches are.
    """
    asked = queries.select("query_id", T.trigram_terms(F.col("query")).alias("terms")).where(F.size("terms") > 0)
    head = F.lower(F.coalesce(F.col(heading), F.lit(""))) if heading else F.lit("")
    rows = df.select(F.col(id_column).alias("chunk_id"), head.alias("head"), F.lower(F.coalesce(F.col(body), F.lit(""))).alias("text"))
    size = F.greatest(F.length("head") - 2, F.lit(0)) + F.greatest(F.length("text") - 2, F.lit(0))
    rows = rows.withColumn("length", size.cast("bigint"))
    corpus = rows.agg(F.count("*").alias("rows"), F.avg("length").alias("mean")) if corpus is None else corpus
    every = asked.select(F.explode("terms").alias("term")).distinct()
    holds = F.col("head").contains(F.col("term")) | F.col("text").contains(F.col("term"))
    hits = rows.join(broadcast_if_small(every), holds)
    counted = hits.select("chunk_id", "length", "term", (T.occurrences(F.col("head"), F.col("term")) + T.occurrences(F.col("text"), F.col("term"))).alias("tf"))
    n = counted.groupBy("term").agg(F.count("*").alias("n"))
    wanted = asked.select("query_id", F.size("terms").alias("needed"), F.explode("terms").alias("term")).groupBy("query_id", "needed", "term").agg(F.count("*").alias("times"))
    scored = counted.join(wanted, "term").join(n, "term").crossJoin(F.broadcast(corpus))
    score = _score(F.col("tf"), F.col("n"), F.col("rows"), F.col("length"), F.col("mean"))
    full = scored.groupBy("query_id", "needed", "chunk_id").agg(F.round(F.sum(score * F.col("times")), SCORE_PLACES).alias("score"), F.sum("times").alias("matched")).where("matched = needed")
    return _top(_kept_books(full, books), "trigram", limit)


def trigram_candidates(postings: DataFrame, queries: DataFrame) -> DataFrame:
    """(chunk_id) of all chunks that hold every trigram of some query term: a superset of what matches."""
    terms = queries.select(F.explode(T.trigram_terms(F.col("query"))).alias("phrase")).distinct()
    needed = terms.select("phrase", F.explode(F.array_distinct(T.trigrams(F.col("phrase")))).alias("term"))
    needed = needed.join(needed.groupBy("phrase").agg(F.count("*").alias("parts")), "phrase")
    held = postings.select("term", "chunk_id").join(needed, "term").groupBy("phrase", "parts", "chunk_id").agg(F.count("*").alias("found"))
    return held.where("found = parts").select("chunk_id").distinct()


@dataclass(frozen=True)
class Index:
    """Stored postings of both indexes, and their statistics (index_name, rows, mean)."""

    words: DataFrame
    trigrams: DataFrame
    statistics: DataFrame

    @classmethod
    def write(cls, df: DataFrame, path: str) -> None:
        """Builds the index below `path`, postings sorted by term, so that a search reads few row groups."""
        for name, made in (("words", word_postings(df)), ("trigrams", trigram_postings(df))):
            made.repartitionByRange("term").sortWithinPartitions("term", "chunk_id").write.mode("overwrite").parquet(f"{path}/{name}")
        stored = [corpus_statistics(df.sparkSession.read.parquet(f"{path}/{name}"), df).select(F.lit(name).alias("index_name"), "rows", "mean") for name in ("words", "trigrams")]
        stored[0].unionByName(stored[1]).coalesce(1).write.mode("overwrite").parquet(f"{path}/statistics")

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> Index:
        return cls(*(spark.read.parquet(f"{path}/{name}") for name in ("words", "trigrams", "statistics")))

    def search(self, df: DataFrame, queries: DataFrame, limit: int, books: DataFrame | None = None) -> DataFrame:
        """As `search`, from the stored postings; only candidates of the trigram index are read from `df`."""
        expanded = queries.select("query_id", T.expand_query(F.col("query")).alias("query"))
        asked = expanded.select("query_id", F.explode(T.query_segments(F.col("query"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("times"))
        literal = [r["term"] for r in asked.select("term").distinct().limit(LITERAL_TERMS + 1).collect()]
        words = self.words.where(F.col("term").isin(literal)) if len(literal) <= LITERAL_TERMS else self.words
        by_word = search_postings(words, self._corpus("words"), asked, limit, books)
        phrases = expanded.select(F.explode(T.trigram_terms(F.col("query"))).alias("p")).select(F.explode(T.trigrams(F.col("p"))).alias("term")).distinct()
        parts = [r["term"] for r in phrases.limit(LITERAL_TERMS + 1).collect()]
        trigrams = self.trigrams.where(F.col("term").isin(parts)) if len(parts) <= LITERAL_TERMS else self.trigrams
        some = df.join(trigram_candidates(trigrams, expanded), "chunk_id", "left_semi")
        return best_of([by_word, trigram_search(some, expanded, limit, books=books, corpus=self._corpus("trigrams"))], limit)

    def added(self, df: DataFrame) -> Index:
        """With the rows of `df` too, which the index didn't hold."""
        words, trigrams = word_postings(df), trigram_postings(df)
        rows = df.agg(F.count("*").alias("rows"))
        changes = [rows.crossJoin(F.broadcast(_lengths(p))).select(F.lit(name).alias("index_name"), "rows", "total") for name, p in (("words", words), ("trigrams", trigrams))]  # single rows
        return Index(self.words.unionByName(words), self.trigrams.unionByName(trigrams), self._changed(changes))

    def without(self, chunk_ids: DataFrame) -> Index:
        """Without the rows named in `chunk_ids` (chunk_id), all of which the index held."""
        gone = chunk_ids.select("chunk_id").distinct()
        rows = gone.agg((-F.count("*")).alias("rows"))
        kept, changes = {}, []
        for name, postings in (("words", self.words), ("trigrams", self.trigrams)):
            total = _lengths(postings.join(gone, "chunk_id", "left_semi")).select((-F.col("total")).alias("total"))
            changes.append(rows.crossJoin(F.broadcast(total)).select(F.lit(name).alias("index_name"), "rows", "total"))  # single rows
            kept[name] = postings.join(gone, "chunk_id", "left_anti").select(*postings.columns)
        return Index(kept["words"], kept["trigrams"], self._changed(changes))

    def _changed(self, changes: list[DataFrame]) -> DataFrame:
        """Statistics after `changes` (index_name, rows, total) of rows and of the sums of their lengths."""
        every = self.statistics.select("index_name", "rows", F.coalesce(F.col("rows") * F.col("mean"), F.lit(0.0)).alias("total"))
        for change in changes:
            every = every.unionByName(change)
        sums = every.groupBy("index_name").agg(F.sum("rows").alias("rows"), F.sum("total").alias("total"))
        return sums.select("index_name", "rows", F.when(F.col("rows") > 0, F.col("total") / F.col("rows")).alias("mean"))

    def store(self, path: str) -> None:
        """Writes the index as it is below `path`, which must not be where it is read from."""
        for name, postings in (("words", self.words), ("trigrams", self.trigrams)):
            postings.repartitionByRange("term").sortWithinPartitions("term", "chunk_id").write.mode("overwrite").parquet(f"{path}/{name}")
        self.statistics.coalesce(1).write.mode("overwrite").parquet(f"{path}/statistics")

    def _corpus(self, name: str) -> DataFrame:
        return self.statistics.where(F.col("index_name") == name).select("rows", "mean")


def best_of(lists: list[DataFrame], limit: int, source: str = "lexical") -> DataFrame:
    """Merge of ranked lists whose scores are lower-is-better: the best score of each chunk, then the best chunks."""
    union = lists[0]
    for one in lists[1:]:
        union = union.unionByName(one)
    return _top(union.groupBy("query_id", "chunk_id").agg(F.min("score").alias("score")), source, limit)


def search(df: DataFrame, queries: DataFrame, limit: int, books: DataFrame | None = None, strict: bool = False, **columns) -> DataFrame:
    """Both indexes, each cut to `limit`, then the best of both. The expanded query goes to both.

    By default a query is reduced to its terms. With `strict`, one that a full-text grammar would refuse (signs,
    bare operators) finds nothing in the trigram index, which takes queries as they are.
    """
    expanded = queries.select("query_id", T.expand_query(F.col("query")).alias("query"))
    raw = expanded.where(T.is_plain_query(F.col("query"))) if strict else expanded
    return best_of([word_search(df, expanded, limit, books=books, **columns), trigram_search(df, raw, limit, books=books, **columns)], limit)
