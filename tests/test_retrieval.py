import math
import random
from collections import Counter

from pyspark.sql import functions as F

from lectorium.functions import terms as T
from lectorium.functions import vectors as V
from lectorium.operators import context, fusion, knn, lexical

DOCS = [(1, "one", "a quiet harbour in the north"), (2, None, "the harbour harbour and the orchard"), (3, "harbour", ""), (4, "", "nothing here"), (5, "five", None)]


def docs(spark, rows=DOCS):
    return spark.createDataFrame(rows, "chunk_id long, heading string, body string")


def asked(spark, *queries):
    return spark.createDataFrame(list(enumerate(queries, 1)), "query_id long, query string")


def brute_bm25(rows, terms, find, lengths):
    n_rows, mean = len(rows), sum(lengths.values()) / len(rows)
    scores = Counter()
    for term in terms:
        tf = {i: f for i in lengths if (f := find(i, term))}
        idf = math.log((n_rows - len(tf) + 0.5) / (len(tf) + 0.5))
        for i, f in tf.items():
            scores[i] -= max(idf, 1e-6 if idf <= 0 else idf) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * lengths[i] / mean))
    return scores


def test_word_search(spark):
    words = {i: f"{h or ''} {b or ''}".split() for i, h, b in DOCS}
    expected = brute_bm25(DOCS, ["harbour", "orchard", "harbour"], lambda i, t: words[i].count(t), {i: len(w) for i, w in words.items()})
    got = {r["chunk_id"]: r["score"] for r in lexical.word_search(docs(spark), asked(spark, "harbour orchard harbour"), 10).collect()}
    assert got.keys() == expected.keys()
    assert all(abs(got[i] - expected[i]) < 1e-9 for i in got)


def test_stored_index_gives_the_same(spark):
    d, q = docs(spark), asked(spark, "harbour north")
    postings = lexical.word_postings(d)
    terms = spark.createDataFrame([(1, "harbour", 1), (1, "north", 1)], "query_id long, term string, times int")
    stored = lexical.search_postings(postings, lexical.corpus_statistics(postings, d), terms, 10)
    direct = lexical.word_search(d, q, 10)
    assert [(r["chunk_id"], round(r["score"], 9)) for r in stored.orderBy("rank").collect()] == [(r["chunk_id"], round(r["score"], 9)) for r in direct.orderBy("rank").collect()]


def test_trigram_search_needs_all_terms(spark):
    rows = [r["chunk_id"] for r in lexical.trigram_search(docs(spark), asked(spark, "arbo the"), 10).orderBy("rank").collect()]
    assert sorted(rows) == [1, 2]
    assert lexical.trigram_search(docs(spark), asked(spark, "in a"), 10).count() == 0
    assert lexical.trigram_search(docs(spark, []), asked(spark, "harbour"), 10).count() == 0
    assert lexical.word_search(docs(spark, []), asked(spark, "harbour"), 10).count() == 0


def test_book_filter_keeps_statistics(spark):
    books = spark.createDataFrame([(1, 2), (1, 4)], "query_id long, chunk_id long")
    every = {r["chunk_id"]: r["score"] for r in lexical.word_search(docs(spark), asked(spark, "harbour"), 10).collect()}
    some = lexical.word_search(docs(spark), asked(spark, "harbour"), 10, books=books).collect()
    assert [(r["chunk_id"], r["score"]) for r in some] == [(2, every[2])]


def random_vectors(n, d, seed=3):
    rng = random.Random(seed)
    return [(i, [rng.gauss(0, 1) for _ in range(d)]) for i in range(n)]


def test_knn(spark):
    rows = random_vectors(60, 8)
    vectors = spark.createDataFrame([*rows, (900, None)], "chunk_id long, embedding array<float>")
    queries = spark.createDataFrame(rows[:4], "query_id long, vector array<float>")
    got = {}
    for r in knn.search(vectors, queries, 5).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["chunk_id"])
    for q, v in rows[:4]:
        assert got[q] == [i for i, _ in sorted(rows, key=lambda x: (math.dist(x[1], v), x[0]))[:5]]


def test_knn_book_filter_may_give_fewer(spark):
    rows = [(i, [float(i)]) for i in range(30)]
    vectors = spark.createDataFrame(rows, "chunk_id long, embedding array<float>")
    queries = spark.createDataFrame([(1, [0.0])], "query_id long, vector array<float>")
    books = spark.createDataFrame([(1, 9), (1, 20)], "query_id long, chunk_id long")
    assert [r["chunk_id"] for r in knn.search(vectors, queries, 2, books=books).collect()] == [9]
    assert [r["chunk_id"] for r in knn.search(vectors, queries, 2, books=books, exact=True).orderBy("rank").collect()] == [9, 20]


def test_binary(spark):
    rows = random_vectors(40, 70, 5)
    vectors = spark.createDataFrame(rows, "chunk_id long, embedding array<float>")
    words = {r["chunk_id"]: r["words"] for r in knn.binary_index(vectors).collect()}
    for i, v in rows:
        assert [w % 2**64 for w in words[i]] == [sum(1 << j for j, x in enumerate(v[k : k + 64]) if x > 0) for k in (0, 64)]
    queries = spark.createDataFrame(rows[:2], "query_id long, vector array<float>")
    found = knn.binary_search(vectors, queries, 3).orderBy("query_id", "rank").collect()
    assert [r["chunk_id"] for r in found if r["rank"] == 1] == [0, 1]
    assert knn.binary_search(vectors.limit(0), queries, 3).count() == 0
    pair = spark.createDataFrame([([1.0, 0.0], [0.0, 0.0])], "a array<float>, b array<float>")
    assert pair.select(V.cosine_distance(F.col("a"), F.col("b"))).first()[0] is None


def test_reciprocal_rank(spark):
    lists = [spark.createDataFrame([(1, s, c, r, 0.0) for r, c in enumerate(ids, 1)], "query_id long, source string, chunk_id long, rank int, score double") for s, ids in (("a", [1, 2]), ("b", [2, 3]))]
    rows = fusion.reciprocal_rank(lists, 10).orderBy("rank").collect()
    assert [r["chunk_id"] for r in rows] == [2, 1, 3]
    assert abs(rows[0]["score"] - (1 / 62 + 1 / 61)) < 1e-12
    assert fusion.reciprocal_rank(lists[0].limit(0), 5).count() == 0


def brute_diversify(books, limit):
    if len(books) <= 1:
        return list(range(len(books)))
    groups = {}
    for i, b in enumerate(books):
        groups.setdefault(b or 0, []).append(i)
    if len(groups) < 2:
        return list(range(len(books)))[:limit]
    out, turns = [], [list(g) for g in groups.values()]
    while any(turns) and len(out) < limit:
        for g in turns:
            if g and len(out) < limit:
                out.append(g.pop(0))
    return out


def test_diversify(spark):
    rng = random.Random(2)
    cases = [[rng.choice([1, 2, 3, None]) for _ in range(rng.randrange(9))] for _ in range(60)] + [[7], [1, 1, 1]]
    rows = [(q, r, b) for q, books in enumerate(cases) for r, b in enumerate(books, 1)]
    df = spark.createDataFrame(rows, "query_id long, rank int, book_id long").withColumn("chunk_id", F.col("rank"))
    got = {}
    for r in fusion.diversify(df, 4).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["chunk_id"] - 1)
    for q, books in enumerate(cases):
        assert got.get(q, []) == brute_diversify(books, 4)


def details(spark):
    chunk = spark.createDataFrame(
        [(10, 1, 1, "h", "x" * 200, 1, 2, None, 11), (11, 1, 1, "h", "middle", 1, 2, 10, 12), (12, 1, 1, "h", "y" * 50, None, 2, 11, None), (20, 9, 7, "h", "other", 3, 3, 12, None)],
        "chunk_id long, book_id long, chapter_id long, heading string, body string, page_start int, page_end int, prev_chunk_id long, next_chunk_id long",
    )
    book, chapter = spark.createDataFrame([(1, "Book A")], "book_id long, title string"), spark.createDataFrame([(1, "Ch 1")], "chapter_id long, title string")
    ranked = spark.createDataFrame([(1, "s", 10, 1, 0.5), (1, "s", 12, 2, 0.4), (1, "s", 20, 3, 0.3), (1, "s", 99, 4, 0.1)], "query_id long, source string, chunk_id long, rank int, score double")
    return context.with_details(ranked, chunk, book, chapter), chunk


def test_context(spark):
    found, chunk = details(spark)
    assert sorted(r["chunk_id"] for r in found.collect()) == [10, 12, 20]
    wide = {r["chunk_id"]: (r["prev_body"], r["next_body"]) for r in context.with_neighbours(found, chunk).collect()}
    assert wide == {10: (None, "middle"), 12: (None, None), 20: (None, None)}
    lines = [r["source_line"] for r in context.sources(found).orderBy("rank").collect()]
    assert lines == ["[1] Book A, Ch 1, pp.1-2", "[2] Book A, Ch 1", "[3] Unknown, pp.3-3"]


def test_prompt(spark):
    found, chunk = details(spark)
    asked_ = spark.createDataFrame([(1, "why?")], "query_id long, query string")
    user = context.prompts(found, asked_, 0, 100).first()["user"]
    assert user.startswith("Excerpts:\n---\n[1] Book: Book A | Chapter: Ch 1 | Pages: 1-2\n" + "x" * 100 + "...\n---\n[2] ")
    assert user.endswith("[3]  | Pages: 3-3\nother\n---\n\nQuestion: why?")
    small = context.prompts(found, asked_, 50, 0).first()["user"]
    assert small.count("\n---\n") == 2 and "[2]" not in small  # the first entry stays though it passes the budget


def test_strict_grammar(spark):
    queries = asked(spark, "harbour?", "harbour NOT orchard", "harbour")
    loose = {r["query_id"] for r in lexical.search(docs(spark), queries, 5).collect()}
    strict = lexical.search(docs(spark), queries, 5, strict=True)
    assert loose == {1, 2, 3} and {r["query_id"] for r in strict.collect()} == {1, 2, 3}  # the word index still answers
    plain = queries.select("query_id", T.is_plain_query(F.col("query")).alias("p")).collect()
    assert [r["p"] for r in plain] == [False, False, True]


def test_stored_index(spark, tmp_path):
    rng = random.Random(3)
    words = ["harbour", "harbours", "orchard", "north", "lantern", "索引", "カタログ", "aaa", "aaaaa", "Größe"]
    rows = [(i, rng.choice(words + [None]), " ".join(rng.choice(words) for _ in range(rng.randrange(1, 9)))) for i in range(80)] + [(900, None, None), (901, "", "")]
    d, q = docs(spark, rows), asked(spark, "harbour north", "aaa", "索引カタログ lantern", "no such thing", "ab", "grosse")
    lexical.Index.write(d, str(tmp_path))
    index = lexical.Index.read(spark, str(tmp_path))
    books = spark.createDataFrame([(1, i) for i in range(0, 80, 2)], "query_id long, chunk_id long")
    for limit, some in ((5, None), (50, None), (5, books)):
        stored, direct = (sorted((r["query_id"], r["rank"], r["chunk_id"], round(r["score"], 9)) for r in x.collect()) for x in (index.search(d, q, limit, some), lexical.search(d, q, limit, some)))
        assert stored == direct and stored


def test_words_of_unspaced_text_are_found(spark):
    rows = [(1, None, "この索引はカタログの品質を説明する"), (2, None, "読書室の静かな夜"), (3, "索引", "その他"), (4, None, "quiet catalogue")]
    df = spark.createDataFrame(rows, "chunk_id long, heading string, body string")
    asked = spark.createDataFrame([(1, "索引の品質"), (2, "カタログ"), (3, "ない")], "query_id long, query string")
    got = {(r["query_id"], r["chunk_id"]) for r in lexical.word_search(df, asked, 10).collect()}
    assert got == {(1, 1), (1, 3), (2, 1)}


def test_equal_scores_rank_by_id(spark):
    body = "harbour lantern margin orchard reader " * 7
    df = spark.createDataFrame([(i, None, body) for i in range(40)], "chunk_id long, heading string, body string").repartition(7)
    asked = spark.createDataFrame([(1, "harbour lantern margin orchard reader")], "query_id long, query string")
    for found in (lexical.word_search(df, asked, 20), lexical.trigram_search(df, asked, 20)):
        assert [r["chunk_id"] for r in found.orderBy("rank").collect()] == list(range(20))
