"""The pN_ queries: each runs a problem's operator, with its usual parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectorium.llm import bpe_trie, cross_polytope, lookalike, mojibake, packing, scan_repair, score_fusion, sentences, spam_trees, text_stats
from lectorium.llm.common import once, table

Query = Callable[[SparkSession, str], DataFrame]


def p1_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics and verdict of every chunk and page; re-delivered rows count once."""
    chunk = table(spark, sf_dir, "chunk").select(F.lit("chunk.body").alias("field"), F.col("chunk_id").alias("row_id"), F.col("body").alias("text"))
    page = table(spark, sf_dir, "page").select(F.lit("page.text").alias("field"), F.col("page_id").alias("row_id"), "text")
    made = text_stats.text_statistics(chunk.unionByName(page), ["field", "row_id"], "text")
    return made.where("row_id is not null").dropDuplicates(["field", "row_id"])


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p1_statistics(spark, sf_dir).where("not is_prose").select("field", "row_id")


def _scan(spark: SparkSession, sf_dir: str) -> scan_repair.Scan:
    page, stats, book, chapter = (table(spark, sf_dir, t) for t in ("page", "extract_stats", "book", "chapter"))
    bodies = table(spark, sf_dir, "chunk").select("body")  # only for the vocabulary, to which re-delivered rows do no harm
    return scan_repair.Scan(page, stats, book, chapter, bodies)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scan(spark, sf_dir).found()


def p2_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, text): every page of scanned books as continuous paragraphs."""
    return _scan(spark, sf_dir).repaired()


def p3_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentences.sentences(once(table(spark, sf_dir, "chunk"), "chunk_id", ["body"]))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = table(spark, sf_dir, "sentence_check").select("chunk_id").distinct()
    ends = sentences.sentences(table(spark, sf_dir, "chunk").join(asked, "chunk_id", "left_semi")).select("chunk_id", "sentence_end")
    return ends.distinct()  # re-delivered chunks give equal rows


def p4_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_fusion.fused_ranking(table(spark, sf_dir, "search_result"), table(spark, sf_dir, "score_list"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_fusion.best(table(spark, sf_dir, "search_result"), table(spark, sf_dir, "score_list"), 5)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = cross_polytope.similar_pairs(table(spark, sf_dir, "chunk_vec"), "chunk_id", "embedding", 0.9)
    return pairs.select(F.col("id_a").alias("chunk_id_a"), F.col("id_b").alias("chunk_id_b"))


def p5_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, neighbour_id, similarity, rank): the 10 nearest chunks of every chunk with a usable vector."""
    vectors = table(spark, sf_dir, "chunk_vec")
    return cross_polytope.nearest(vectors, "chunk_id", "embedding", vectors.select("chunk_id"), 10)


def p5_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As p5_neighbours, for the stated queries: every chunk whose id is divisible by 100."""
    vectors = table(spark, sf_dir, "chunk_vec")
    return cross_polytope.nearest(vectors, "chunk_id", "embedding", vectors.where("chunk_id % 100 = 0").select("chunk_id"), 10)


def p6_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(field, row_id, form): the consistent form of each title and body."""
    books = lookalike.normalised(once(table(spark, sf_dir, "book"), "book_id", ["title"]), "book_id", "title")
    chunks = lookalike.normalised(once(table(spark, sf_dir, "chunk"), "chunk_id", ["body"]), "chunk_id", "body")
    named = [d.select(F.lit(f).alias("field"), F.col(k).alias("row_id"), "form") for f, k, d in (("book.title", "book_id", books), ("chunk.body", "chunk_id", chunks))]
    return named[0].unionByName(named[1])


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    books = lookalike.same_look_pairs(table(spark, sf_dir, "book"), "book_id", "title")
    chunks = lookalike.same_look_pairs(table(spark, sf_dir, "chunk"), "chunk_id", "body")
    return books.select(F.lit("book.title").alias("field"), "id_a", "id_b").unionByName(chunks.select(F.lit("chunk.body").alias("field"), "id_a", "id_b"))


def p7_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, chain, restored, complete) of every page that was decoded wrongly, in whole or in part."""
    # re-delivered pages give equal rows, and few pages give any: dropping them after shuffles no text
    return mojibake.garbled(table(spark, sf_dir, "page").where("page_id is not null")).dropDuplicates(["page_id"])


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p7_restored(spark, sf_dir).select("page_id")


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_trie.encode_corpus(table(spark, sf_dir, "documents"))


def p9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(container_id, doc_id, piece, size, pack_id, pack_offset) for every document and every capacity."""
    sizes = bpe_trie.count_tokens(table(spark, sf_dir, "documents"))
    containers = table(spark, sf_dir, "container_size").where("capacity_tokens > 0").orderBy("container_id").collect()  # 3 rows, fixed
    return packing.pack_all(sizes, [(r["container_id"], r["capacity_tokens"]) for r in containers])


def p10_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spam_trees.spam_scores(table(spark, sf_dir, "documents"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p10_scores(spark, sf_dir).where("score > 0.5").select("doc_id")


QUERIES: dict[str, Query] = {f.__name__: f for f in (p1_found, p1_statistics, p2_found, p2_repaired, p3_found, p3_sentences, p4_found, p4_ranking, p5_found, p5_neighbours, p5_search, p6_found, p6_forms, p7_found, p7_restored, p8_ids, p9_packing, p10_found, p10_scores)}
_FUSED = f"""WITH raw AS (SELECT query_id, score_list, chunk_id, better, CASE WHEN score IS NULL OR isnan(score) THEN json_extract(item_json, '$.score')::DOUBLE ELSE score END AS s FROM search_result JOIN score_list USING (score_list))
, best AS (SELECT query_id, score_list, chunk_id, max(CASE WHEN better = 'high' THEN s ELSE -s END) AS s FROM raw WHERE s IS NOT NULL AND isfinite(s) GROUP BY ALL)
, middle AS (SELECT query_id, score_list, median(s) AS m FROM best GROUP BY ALL)
, gaps AS (SELECT *, abs(s - m) AS gap FROM best JOIN middle USING (query_id, score_list))
, spread AS (SELECT query_id, score_list, CASE WHEN median(gap) > 0 THEN median(gap) * 1.4826 WHEN avg(gap) > 0 THEN avg(gap) * 1.2533 END AS unit FROM gaps GROUP BY ALL)
, gains AS (SELECT query_id, chunk_id, score_list, ln({score_fusion.FLOOR} + {1 - score_fusion.FLOOR} / (1 + exp(-coalesce((s - m) / unit, 0)))) - ln({score_fusion.FLOOR}) AS gain FROM gaps JOIN spread USING (query_id, score_list))
, lists AS (SELECT query_id, count(DISTINCT score_list) AS n FROM gains GROUP BY query_id)
, fused AS (SELECT query_id, chunk_id, exp(ln({score_fusion.FLOOR}) + sum(gain) / any_value(n)) AS fused_score FROM gains JOIN lists USING (query_id) GROUP BY ALL)
, ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY fused_score DESC, chunk_id) AS fused_rank FROM fused)"""
#: SQL of the queries that SQL can say; the others are tested against brute force, exact round trips and held-out rows.
ORACLE_SQL: dict[str, str] = {
    "p4_found": f"{_FUSED} SELECT query_id, chunk_id FROM ranked WHERE fused_rank <= 5",
    "p5_found": """WITH v AS (SELECT chunk_id, any_value(embedding)::DOUBLE[] AS e FROM chunk_vec WHERE len(embedding) = 64 GROUP BY chunk_id)
, u AS (SELECT * FROM v WHERE list_sum(list_transform(e, lambda x: x * x)) > 0)
SELECT a.chunk_id AS chunk_id_a, b.chunk_id AS chunk_id_b FROM u a JOIN u b ON a.chunk_id < b.chunk_id WHERE list_cosine_similarity(a.e, b.e) >= 0.9""",
}
