"""The library as an object: ingest, search, ask, reindex, inspect, delete, export."""

from __future__ import annotations

import time
from collections.abc import Sequence
from dataclasses import dataclass, field
from enum import Enum

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectorium import schema as S
from lectorium.config import Config
from lectorium.functions import terms
from lectorium.functions.text import clean_text, title_or_stem
from lectorium.operators import catalog, chunking, context, fusion, knn, lexical, orchestrate, quality
from lectorium.sources import exchange, files, storage
from lectorium.sources.connectors import Embedder, HashingEmbedder, LanguageModel, answer, embed

TABLES = {"book": S.BOOK, "chapter": S.CHAPTER, "chunk": S.CHUNK, "chunk_vec": S.CHUNK_VEC, "chunk_vec_binary": S.CHUNK_VEC_BINARY, "ingest_log": S.INGEST_LOG}


class Mode(str, Enum):
    FTS = "fts"
    VECTOR = "vector"
    HYBRID = "hybrid"


class NoResultsError(LookupError):
    """No source of a search gave anything."""


@dataclass
class Engine:
    """Operators over tables of one library; the tables are DataFrames, stored only by `save`."""

    spark: SparkSession
    tables: dict[str, DataFrame]
    config: Config = field(default_factory=Config)
    embedder: Embedder | None = None
    index: lexical.Index | None = None

    def __post_init__(self) -> None:
        self.embedder = self.embedder or HashingEmbedder(self.config.embedding_dimension)

    # tables

    @classmethod
    def open(cls, spark: SparkSession, path: str, config: Config | None = None, embedder: Embedder | None = None) -> Engine:
        """Library stored below `path`, as it was saved last; tables that aren't there are empty."""
        version = storage.read_text(spark, f"{path}/CURRENT")
        place = f"{path}/{version.strip()}" if version else path
        found = {name: spark.read.parquet(f"{place}/{name}") if storage.exists(spark, f"{place}/{name}") else spark.createDataFrame([], kind) for name, kind in TABLES.items()}
        engine = cls(spark, found, config or Config(), embedder)
        if storage.exists(spark, f"{place}/index/statistics"):
            engine.index = lexical.Index.read(spark, f"{place}/index")
        return engine

    def save(self, path: str) -> None:
        """Writes all tables, and the lexical index if one is open, into a new folder below `path`, and then names it the current one.

        What is read stays as it is until all is written, so a library may be saved where it was opened, and a
        save that fails changes nothing. The version before is kept for those who still read it; older ones go.
        """
        versions = sorted(int(f[2:]) for f in storage.folders(self.spark, path) if f.startswith("v-") and f[2:].isdigit())
        number = (versions[-1] if versions else 0) + 1
        place = f"{path}/v-{number}"
        for name, table in self.tables.items():
            table.write.mode("overwrite").parquet(f"{place}/{name}")
        if self.index:
            self.index.store(f"{place}/index")
        before = storage.read_text(self.spark, f"{path}/CURRENT")
        storage.write_text(self.spark, f"{path}/CURRENT", f"v-{number}")
        for old in versions:
            if f"v-{old}" != (before or "").strip():
                storage.remove(self.spark, f"{path}/v-{old}")
        opened = Engine.open(self.spark, path, self.config, self.embedder)
        self.tables, self.index = {**self.tables, **opened.tables}, opened.index

    # ingest

    def ingest(self, path: str, force: bool = False, tags: Sequence[str] = (), embedding: bool = True) -> DataFrame:
        """Adds the book files below `path`; gives (source_path, status, quality, chunks) of each file looked at."""
        found = files.find_books(self.spark, path)
        fresh = catalog.new_files(found.where("book_format <> ''"), self.tables["book"], force)
        if force:
            old = self.tables["book"].join(fresh.select("source_path"), "source_path", "left_semi").select("book_id")
            self._delete(old)
        raw = files.contents(self.spark, path).join(fresh.select("source_path"), "source_path", "left_semi")
        probed = files.probe(raw).join(fresh.select("source_path", "file_hash"), "source_path")
        pages = files.pages(raw).where("error is null").select("source_path", "page_num", clean_text(F.col("text")).alias("text"))
        return self.add(probed, pages, tags, embedding)

    def add(self, probed: DataFrame, pages: DataFrame, tags: Sequence[str] = (), embedding: bool = True) -> DataFrame:
        """Adds probed files with their pages (source_path, page_num, text); gives the status of each file."""
        now = F.current_timestamp()
        named = probed.withColumn("title", title_or_stem(F.col("title"), F.col("source_path"), F.col("book_format")))
        numbered = catalog.with_ids(named, self.tables["book"], "book_id", ["source_path"])
        page = pages.join(numbered.select("source_path", "book_id"), "source_path").select("book_id", "page_num", "text")
        graded = numbered.join(quality.classify(numbered, page), "book_id", "left")
        passed, skipped = quality.gate(graded)
        page, passed = quality.repair_epubs(page.join(passed.select("book_id"), "book_id", "left_semi"), passed)
        totals = passed.select("book_id", F.col("page_count").alias("total"))
        given = passed.where(F.size("toc") > 0).select("book_id", F.posexplode("toc").alias("chapter_order", "e")).select("book_id", F.col("e.title").alias("title"), "chapter_order", F.col("e.page").alias("page_start"))
        with_pages = chunking.chapter_ends(given.where("page_start is not null"), totals)
        spread = chunking.spread_chapters(given.where("page_start is null").groupBy("book_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("chapter_order", "title"))), lambda x: x["title"]).alias("titles")), totals.join(with_pages.select("book_id").distinct(), "book_id", "left_anti"))
        chapter = catalog.with_ids(with_pages.unionByName(spread), self.tables["chapter"], "chapter_id", ["book_id", "chapter_order"])
        cut = chunking.chunk_pages(page, chapter, self.config.chunk_size, self.config.chunk_overlap)
        cut = catalog.with_ids(chunking.known_chapters(cut, chapter), self.tables["chunk"], "chunk_id", ["book_id", "chapter_id", "chunk_order"])
        linked = chunking.link(cut).withColumn("embedding_version", F.lit(self.config.embedding_model if embedding else "")).withColumn("created_at", now)
        book = passed.withColumn("author", F.coalesce("author", F.lit(""))).withColumn("tags", exchange.tags_json(F.array(*map(F.lit, tags)).cast("array<string>"))).withColumn("ingested_at", now).withColumn("updated_at", now)
        self._append("book", book)
        self._append("chapter", chapter)
        self._append("chunk", linked)
        if self.index:
            self.index = self.index.added(linked)
        if embedding:
            self._append("chunk_vec", embed(linked, self.embedder, batch_size=self.config.embedding_batch_size).where("embedding is not null"))
        counts = linked.groupBy("book_id").agg(F.count("*").alias("chunks"))
        status = passed.select("source_path", "book_id", F.lit("completed").alias("status"), "quality").unionByName(skipped.select("source_path", "book_id", F.lit("skipped").alias("status"), "quality"))
        status = status.join(counts, "book_id", "left").withColumn("chunks", F.coalesce("chunks", F.lit(0)))
        self._log(status)
        return status.select("source_path", "status", "quality", "chunks")

    def _log(self, status: DataFrame) -> None:
        """Adds to the ingest log what became of each file; one that was skipped has no book to name."""
        done = F.col("status") == "completed"
        message = F.when(done, F.concat(F.col("chunks").cast("string"), F.lit(" chunks of "), "source_path")).otherwise(F.concat(F.coalesce("quality", F.lit("failed")), F.lit(": "), "source_path"))
        rows = status.select(F.when(done, F.col("book_id")).alias("book_id"), F.when(done, F.lit("completed")).otherwise(F.lit("failed")).alias("status"), message.alias("message"), F.current_timestamp().alias("created_at"))
        self._append("ingest_log", catalog.with_ids(rows, self.tables["ingest_log"], "log_id", ["message"]))

    def _append(self, name: str, rows: DataFrame) -> None:
        kind = TABLES[name]
        self.tables[name] = self.tables[name].unionByName(rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in kind.fields]))

    # search

    def search(self, queries: DataFrame, limit: int | None = None, mode: Mode | str = Mode.HYBRID, book_id: int | None = None) -> DataFrame:
        """Results with details for each query (query_id, query); an unknown mode is an error."""
        limit = limit or self.config.search_limit
        try:
            mode = Mode(mode)
        except ValueError:
            raise ValueError(f"unknown search mode: {mode}") from None
        if mode is Mode.FTS:
            return self.details(self._lexical(queries, limit, self._books(queries, book_id)))
        if mode is Mode.VECTOR:
            return self.details(knn.search(self.tables["chunk_vec"], self._embedded(queries, "query"), limit, books=self._books(queries, book_id)))
        return self._fused(queries, None, limit, book_id)

    def search_one(self, question: str, limit: int | None = None, mode: Mode | str = Mode.HYBRID, book_id: int | None = None) -> list[Row]:
        """Results of one question in their order; nothing from any source is an error, as an empty index is."""
        if mode == Mode.FTS:
            asked = self.spark.createDataFrame([(1, question)], "query_id long, query string")
        else:  # one question is embedded here rather than by a job
            asked = self.spark.createDataFrame([(1, question, [float(x) for x in self.embedder([question])[0]])], "query_id long, query string, vector array<float>")
        rows = self.search(asked, limit, mode, book_id).orderBy("rank").collect()  # at most `limit` rows
        if not rows:
            raise NoResultsError(f"nothing found by {Mode(mode).value}")
        return rows

    def capture(self, queries: DataFrame, limit: int = 5) -> DataFrame:
        """Results of each query by lexical and by hybrid search, with a column `mode`, for evaluation."""
        fts = self.search(queries, limit, Mode.FTS).withColumn("mode", F.lit("fts"))
        return fts.unionByName(self.search(queries, limit, Mode.HYBRID).withColumn("mode", F.lit("hybrid")), allowMissingColumns=True)

    def search_hyde(self, queries: DataFrame, limit: int | None = None, book_id: int | None = None) -> DataFrame:
        """Hybrid search with the vectors of a hypothesis as a third list. `queries`: (query_id, query, hypothesis);
        an empty hypothesis adds nothing."""
        return self._fused(queries, "hypothesis", limit or self.config.search_limit, book_id)

    def _fused(self, queries: DataFrame, hypothesis: str | None, limit: int, book_id: int | None) -> DataFrame:
        fetch, books = limit * S.FETCH_MULTIPLIER, self._books(queries, book_id)
        lists = [self._lexical(queries, fetch, books), knn.search(self.tables["chunk_vec"], self._embedded(queries, "query"), fetch, books=books)]
        if hypothesis:
            lists.append(knn.search(self.tables["chunk_vec"], self._embedded(queries.where(F.coalesce(hypothesis, F.lit("")) != ""), hypothesis), fetch, source="hyde", books=books))
        spread = F.lit(book_id is None or book_id <= 0) & terms.is_comparison(F.col("query"))
        asked = queries.select("query_id", spread.alias("spread"))
        pool = self.details(fusion.reciprocal_rank(lists, limit * S.COMPARISON_POOL)).join(asked, "query_id")
        return fusion.diversify(pool, limit, F.col("spread")).drop("spread")

    def _lexical(self, queries: DataFrame, limit: int, books: DataFrame | None) -> DataFrame:
        """From the stored index if one is open, else from the texts."""
        chunk = self.tables["chunk"]
        return self.index.search(chunk, queries, limit, books) if self.index else lexical.search(chunk, queries, limit, books)

    def details(self, ranked: DataFrame) -> DataFrame:
        return context.with_details(ranked, self.tables["chunk"], self.tables["book"], self.tables["chapter"])

    def _embedded(self, queries: DataFrame, column: str) -> DataFrame:
        """Vectors of the queries: those they bring along in a column `vector`, else the embedder's."""
        if column == "query" and "vector" in queries.columns:
            return queries.select("query_id", "vector").where("vector is not null")
        return embed(queries, self.embedder, "query_id", column).where("embedding is not null").withColumnRenamed("embedding", "vector")

    def _books(self, queries: DataFrame, book_id: int | None) -> DataFrame | None:
        if book_id is None or book_id <= 0:
            return None
        own = self.tables["chunk"].where(F.col("book_id") == book_id).select("chunk_id")
        return queries.select("query_id").crossJoin(own)  # the chunks of one book for each of the few queries

    # ask

    def build_context(self, queries: DataFrame, results: DataFrame, expand: bool = False) -> DataFrame:
        """(query_id, system, user, sources) from results."""
        per_chunk = max(self.config.prompt_chunk_limit, S.PROMPT_PER_CHUNK_EXPANDED) if expand else self.config.prompt_chunk_limit
        wide = context.with_neighbours(results, self.tables["chunk"]) if expand else results
        made = context.prompts(wide, queries, self.config.prompt_budget, per_chunk, expand)
        return made.join(context.formatted_sources(results), "query_id")

    def ask(self, question: str, model: LanguageModel, limit: int = 5, book_id: int | None = None, expand: bool = False, hyde: bool = False) -> dict:
        """Answer and sources of one question; without any result the model isn't asked."""
        began = time.perf_counter()
        queries = self.spark.createDataFrame([(1, question)], "query_id long, query string")
        if hyde:
            guess = model(context.HYDE_PROMPT, question)
            results = self.search_hyde(queries.withColumn("hypothesis", F.lit(guess or "")), limit, book_id)
        else:
            results = self.search(queries, limit, Mode.HYBRID, book_id)
        row = self.build_context(queries, results, expand).first()
        found = time.perf_counter()
        if row is None:
            return {"answer": "", "sources": "", "retrieval_ms": int((found - began) * 1000), "generation_ms": 0, "total_ms": int((found - began) * 1000)}
        said = answer(model, row["system"], row["user"])
        done = time.perf_counter()
        return {"answer": said, "sources": row["sources"], "retrieval_ms": int((found - began) * 1000), "generation_ms": int((done - found) * 1000), "total_ms": int((done - began) * 1000)}

    # upkeep

    def rebuild_lexical(self, path: str) -> None:
        """Writes the lexical index below `path` and searches it from now on."""
        lexical.Index.write(self.tables["chunk"], path)
        self.index = lexical.Index.read(self.spark, path)

    def rebuild_embeddings(self, book_id: int | None = None) -> None:
        chosen = self.tables["chunk"] if book_id is None else self.tables["chunk"].where(F.col("book_id") == book_id)
        new = embed(chosen, self.embedder, batch_size=self.config.embedding_batch_size).where("embedding is not null")
        self.tables["chunk_vec"] = knn.upsert(self.tables["chunk_vec"].select("chunk_id", "embedding"), new)

    def rebuild_links(self) -> None:
        self.tables["chunk"] = chunking.link(self.tables["chunk"].drop("prev_chunk_id", "next_chunk_id")).select(*self.tables["chunk"].columns)

    def rebuild_binary(self) -> int:
        self.tables["chunk_vec_binary"] = knn.binary_index(self.tables["chunk_vec"])
        return self.tables["chunk_vec_binary"].count()

    def reindex(self, path: str, fts: bool = False, embedding: bool = False, links: bool = False, binary: bool = False, book_id: int | None = None) -> None:
        """Links or binary vectors alone if asked for; else the lexical index and the vectors, both unless one is named."""
        if links or binary:
            if links:
                self.rebuild_links()
            if binary:
                self.rebuild_binary()
            return
        if fts or not embedding:
            self.rebuild_lexical(path)
        if embedding or not fts:
            self.rebuild_embeddings(book_id)

    def delete_book(self, book_id: int) -> None:
        self._delete(self.spark.createDataFrame([(book_id,)], "book_id long"))

    def _delete(self, book_ids: DataFrame) -> None:
        """Takes books out of all tables and out of the lexical index."""
        if self.index:
            self.index = self.index.without(self.tables["chunk"].join(book_ids, "book_id", "left_semi").select("chunk_id"))
        self.tables = catalog.delete_books(self.tables, book_ids)

    def export(self, path: str, kind: str = "json", book_id: int | None = None) -> None:
        exchange.export(catalog.export_rows(self.tables["book"], self.tables["chunk"], book_id), path, kind)

    def inspect(self, book_id: int | None = None, chunk_id: int | None = None) -> DataFrame:
        """Lines of text: one chunk, the chapters of one book with their chunks, or the list of all books."""
        if chunk_id is not None:
            return exchange.chunk_text(catalog.first_where(self.tables["chunk"], "chunk_id", chunk_id, "chunk_id")).select("line")
        if book_id is None:
            return exchange.books_text(self.tables["book"]).orderBy("book_id").select("line")
        counts = catalog.chunks_of(self.tables["chunk"], book_id).groupBy("chapter_id").agg(F.count("*").alias("chunks"))
        rows = catalog.chapters_of(self.tables["chapter"], book_id).join(counts, "chapter_id", "left").orderBy("chapter_order")
        pages = F.when(F.col("page_start").isNotNull() & F.col("page_end").isNotNull(), F.format_string("pages %d-%d", "page_start", "page_end"))
        return rows.select(F.concat_ws(", ", F.concat(F.col("chapter_order").cast("string"), F.lit(". "), "title"), pages, F.format_string("%d chunks", F.coalesce("chunks", F.lit(0)))).alias("line"))

    def doctor(self) -> DataFrame:
        """(check, passed, detail) of what health can't see: keys, links, vectors, coverage of the index, last failures."""
        book, chapter, chunk, vectors = (self.tables[n] for n in ("book", "chapter", "chunk", "chunk_vec"))
        twice = book.groupBy("source_path").count().where("count > 1")
        lost = chunk.join(book, "book_id", "left_anti").unionByName(chunk.join(chapter, "chapter_id", "left_anti")).select("chunk_id").distinct()
        ids = chunk.select(F.col("chunk_id").alias("to"))
        links = chunk.select(F.explode(F.array("prev_chunk_id", "next_chunk_id")).alias("to")).where("to is not null").join(ids, "to", "left_anti")
        missing = catalog.without_vectors(chunk, vectors)
        odd = vectors.where(F.size("embedding") != self.config.embedding_dimension)
        failed = self.tables["ingest_log"].where("status = 'failed'")
        found = [("one book a path", twice), ("chunks have their book and chapter", lost), ("links lead to chunks", links), ("every chunk has a vector", missing), (f"vectors have {self.config.embedding_dimension} numbers", odd), ("no file failed", failed)]
        if self.index:
            found.append(("the index holds every chunk that has words", chunk.where(F.size(terms.words(F.concat_ws(" ", "heading", "body"))) > 0).join(self.index.words.select("chunk_id").distinct(), "chunk_id", "left_anti")))
        made = None
        for name, rows in found:
            one = rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("check"), (F.col("n") == 0).alias("passed"), F.concat(F.col("n").cast("string"), F.lit(" found")).alias("detail"))
            made = one if made is None else made.unionByName(one)
        return made

    def statistics(self) -> DataFrame:
        return catalog.library_statistics(*(self.tables[n] for n in ("book", "chapter", "chunk", "chunk_vec")))

    def prune_candidates(self, jobs: DataFrame, **options) -> DataFrame:
        return orchestrate.prune(jobs, F.current_timestamp(), **options)

    def health(self) -> dict[str, bool]:
        """Checks that need no data: schemas, embedder, Spark."""
        try:
            vectors = self.embedder(["check"])
            embeds = len(vectors) == 1 and len(vectors[0]) > 0
        except Exception:  # noqa: BLE001 - any failure means unhealthy
            embeds = False
        fits = all({f.name for f in kind.fields} <= set(self.tables[name].columns) for name, kind in TABLES.items() if name in self.tables)
        return {"tables": fits, "embedder": embeds, "spark": not self.spark.sparkContext._jsc.sc().isStopped(), "settings": self.config.chunk_size > 0}


def empty_library(spark: SparkSession) -> dict[str, DataFrame]:
    return {name: spark.createDataFrame([], T.StructType(kind.fields)) for name, kind in TABLES.items()}
