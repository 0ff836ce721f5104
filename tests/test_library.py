import http.server
import io
import json
import random
import threading
import zipfile

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectorium import schema as S
from lectorium.config import Config
from lectorium.operators import catalog, chunking, evaluate, knn, orchestrate, quality
from lectorium.plans import jobs
from lectorium.plans.engine import Engine, empty_library
from lectorium.sources import connectors, exchange, files
from lectorium.streaming import ingest as stream


def packed(pieces, size):
    """Indices where a new group begins, found by trying every length."""
    groups, start = [], 0
    while start < len(pieces):
        end = max(e for e in range(start + 1, len(pieces) + 1) if e == start + 1 or sum(map(len, pieces[start:e])) <= size)
        groups.append(pieces[start:end])
        start = end
    return groups


def brute_force_split(text, size):
    ends = [i + 1 for i, c in enumerate(text) if c in "。？！\n"]
    pieces = [text[a:b] for a, b in zip([0, *ends], [*ends, len(text)])]
    groups = ["".join(g).strip() for g in packed(pieces, size)]
    return [g for i, g in enumerate(groups) if g or i + 1 < len(groups)] or [text]


def brute_chunks(parts, size, overlap):
    bodies = []
    for group in packed(parts, size):
        lead = bodies[-1][max(0, len(bodies[-1]) - overlap) :] if bodies and overlap else ""
        bodies.append("\n\n".join(filter(None, [lead, "\n\n".join(group)])))
    return bodies


def test_chunks_against_a_loop(spark):
    rng = random.Random(6)
    texts = ["\n\n".join("".join(rng.choice("abc。 ！\n漢") for _ in range(rng.randrange(90))) for _ in range(rng.randrange(7))) for _ in range(150)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    for size, overlap in ((30, 8), (12, 0)):
        got = {}
        for r in chunking.chunk_texts(df, "text", size, overlap).orderBy("i", "chunk_order").collect():
            assert r["char_count"] == len(r["body"])
            got.setdefault(r["i"], []).append(r["body"])
        for i, text in enumerate(texts):
            import re

            paragraphs = [p.strip() for p in re.split(r"\n{2,}", text) if p.strip()]
            parts = [x for p in paragraphs for x in (brute_force_split(p, size) if len(p) > 2 * size else [p])]
            assert got.get(i, []) == brute_chunks(parts, size, overlap)


def test_chunk_pages(spark):
    page = spark.createDataFrame([(1, 1, "Hello world"), (1, 2, "two"), (1, 3, None), (1, 9, "lost")], S.PAGE)
    chapter = spark.createDataFrame([(1, 1, "A", 0, 1, 2), (2, 1, "B", 1, 3, 3), (3, 1, "C", 2, 5, 6)], S.CHAPTER)
    rows = chunking.chunk_pages(page, chapter).collect()
    assert [(r["heading"], r["page_start"], r["page_end"], r["chunk_order"], r["body"]) for r in rows] == [("A", 1, 2, 0, "Hello world\n\ntwo")]


def test_spread_and_ends(spark):
    pages = spark.createDataFrame([(1, 10), (2, 3)], "book_id long, total int")
    titles = spark.createDataFrame([(1, ["a", "b"])], "book_id long, titles array<string>")
    rows = sorted(tuple(r) for r in chunking.spread_chapters(titles, pages).collect())
    assert rows == [(1, "a", 0, 1, 5), (1, "b", 1, 6, 10), (2, "全体", 0, 1, 3)]
    starts = spark.createDataFrame([(1, "a", 0, 1), (1, "b", 1, 4)], "book_id long, title string, chapter_order int, page_start int")
    assert sorted(tuple(r) for r in chunking.chapter_ends(starts, pages).collect()) == [(1, "a", 0, 1, 3), (1, "b", 1, 4, 10)]


def test_links(spark):
    rows = spark.createDataFrame([(5, 1, 1, 0), (6, 1, 1, 1), (7, 1, 2, 0)], "chunk_id long, book_id long, chapter_id long, chunk_order int")
    assert {r["chunk_id"]: (r["prev_chunk_id"], r["next_chunk_id"]) for r in chunking.link(rows).collect()} == {5: (None, 6), 6: (5, None), 7: (None, None)}


def test_quality(spark):
    bad, good = "�" * 10, "clean text of a page"
    page = spark.createDataFrame([(1, n, "  ") for n in range(3)] + [(2, n, bad) for n in range(4)] + [(3, n, bad if n == 4 else good) for n in range(10)], S.PAGE)
    books = spark.createDataFrame([(i,) for i in range(5)], "book_id long")
    got = {r["book_id"]: r["quality"] for r in quality.classify(books, page).collect()}
    assert got == {0: "extract_failed", 1: "ocr_required", 2: "text_corrupt", 3: "ok", 4: "extract_failed"}
    passed, skipped = quality.gate(quality.classify(books, page))
    assert sorted(r["book_id"] for r in passed.collect()) == [2, 3] and skipped.count() == 3


@pytest.mark.parametrize(("total", "places"), [(3, [0, 1, 2]), (9, list(range(9))), (100, [0, 1, 2, 49, 50, 51, 97, 98, 99])])
def test_sampled(spark, total, places):
    df = spark.range(total).where(quality.is_sampled(F.col("id"), F.lit(total)))
    assert sorted(r["id"] for r in df.collect()) == places


def test_ocr(spark):
    pages = spark.createDataFrame([(1, n, "" if n < 3 else "x") for n in range(1, 4)] + [(2, 1, "t")], S.PAGE)
    assert {r["book_id"]: r["extraction_mode"] for r in quality.ocr_vote(pages).collect()} == {1: "ocr-heavy", 2: "text"}
    df = spark.createDataFrame([("ab", "abc"), ("a b", "ab"), ("x" * 60, "y" * 90), (None, None)], "f string, a string")
    assert [r[0] for r in df.select(quality.preferred_ocr(F.col("f"), F.col("a"))).collect()] == ["abc", "a b", "x" * 60, ""]
    keyed = pages.withColumn("cache_key", quality.ocr_cache_key(F.lit("h"), F.col("page_num"), F.lit(2.0), F.lit(0)))
    cache = keyed.where("book_id = 2").select("cache_key", F.lit("cached").alias("text"))
    hit, miss = quality.with_ocr_cache(keyed, cache)
    assert hit.count() + miss.count() == 4 and {r["text"] for r in hit.collect()} == {"cached"}


def test_new_files(spark):
    files_ = spark.createDataFrame([("/a", "1"), ("/b", "2"), ("/c", "2"), ("/d", "3")], "source_path string, file_hash string")
    book = spark.createDataFrame([("/a", "9"), ("/z", "3")], "source_path string, file_hash string")
    assert [r["source_path"] for r in catalog.new_files(files_, book).collect()] == ["/b"]
    assert catalog.new_files(files_, book, force=True).count() == 4


def test_with_ids_are_dense(spark):
    rows = spark.range(1000).select((F.col("id") * 7 % 1000).alias("k"))
    stored = spark.createDataFrame([(41,)], "n long")
    made = catalog.with_ids(rows, stored, "n", ["k"]).orderBy("n").collect()
    assert [r["n"] for r in made] == list(range(42, 1042))
    assert [r["k"] for r in made] == sorted(r["k"] for r in made)
    assert catalog.with_ids(rows.limit(0), stored, "n", ["k"]).count() == 0


def test_current_takes_the_latest(spark):
    rows = spark.createDataFrame([(1, "old", 1), (1, "new", 2), (None, "x", 3), (2, "only", None)], "k long, v string, s long").withColumn("t", F.timestamp_seconds("s")).drop("s")
    assert {r["k"]: r["v"] for r in catalog.current(rows, "k", "t").collect()} == {1: "new", 2: "only"}


def test_delete(spark):
    chunk = spark.createDataFrame([(1, 1, None), (2, 2, 1), (3, 2, 2)], "chunk_id long, book_id long, prev_chunk_id long")
    tables = {"book": spark.createDataFrame([(1,), (2,)], "book_id long"), "chunk": chunk, "chunk_vec": spark.createDataFrame([(1,), (3,)], "chunk_id long"), "chunk_vec_binary": spark.createDataFrame([(1,)], "chunk_id long")}
    left = catalog.delete_books(tables, spark.createDataFrame([(1,)], "book_id long"))
    assert {r["chunk_id"]: r["prev_chunk_id"] for r in left["chunk"].collect()} == {2: None, 3: 2}
    assert [r[0] for r in left["chunk_vec"].collect()] == [3] and left["chunk_vec_binary"].count() == 0 and left["book"].count() == 1


def test_evaluation(spark):
    results = spark.createDataFrame([(1, r, t) for r, t in enumerate(["Alpha Beta", "Gamma", "x", "y", "z", "Delta"], 1)], "query_id long, rank int, book_title string")
    expected = spark.createDataFrame([(1, ["Alpha", "amma"]), (2, ["Alpha"]), (3, [])], "query_id long, titles array<string>")
    hits = evaluate.hit_rate(results, expected)
    assert {r["query_id"]: r["hit"] for r in hits.collect()} == {1: True, 2: False, 3: True}
    assert evaluate.rate(hits).first()["hits"] == 2
    some = spark.createDataFrame([(1, ["Alpha", "Delta", "no"]), (3, [])], "query_id long, titles array<string>")
    assert {r["query_id"]: r["coverage"] for r in evaluate.source_coverage(results, some).collect()} == {1: 66.7, 3: None}
    asks = spark.createDataFrame([(t, 0, t) for t in range(1, 21)], "total_ms int, retrieval_ms int, generation_ms int")
    row = evaluate.latency_summary(asks).first()
    assert (row["median_total_ms"], row["p95_total_ms"], row["median_retrieval_ms"]) == (10.0, 19.0, 0.0)


def test_makespan(spark):
    assert evaluate.makespan_of([5, 4, 3, 3, 3], 2) == 10 and evaluate.makespan_of([], 3) == 0 and evaluate.makespan_of([7, 1], 1) == 8
    batches = spark.createDataFrame([("a", 5), ("a", 4), ("a", 0), ("b", 2)], "job_id string, batch_ms int")
    assert {(r["job_id"], r["workers"]): r["makespan_ms"] for r in evaluate.makespan(batches, (1, 2)).collect()} == {("a", 1): 9, ("a", 2): 5, ("b", 1): 2, ("b", 2): 2}


def test_orchestration(spark):
    books = spark.createDataFrame([(1, 130, 64), (2, 0, 64)], "book_id long, page_count int, batch_size int")
    ranges = orchestrate.batch_ranges(books)
    assert [(r["page_start"], r["page_end"]) for r in ranges.orderBy("batch").collect()] == [(1, 64), (65, 128), (129, 130)]
    assert orchestrate.pending(ranges, ranges.where("batch = 1")).count() == 2
    plan = spark.createDataFrame([(900, 8, 0, 0), (12000, 8, 0, 0), (30000, 4, 0, 0), (30000, 8, 4 * orchestrate.GIB, 0), (30000, 8, 0, 100 * orchestrate.MIB)], "ms long, cores int, total long, free long")
    cap = orchestrate.host_cap(F.col("cores"), F.col("total"), F.col("free"), F.lit(0))
    assert [r[0] for r in plan.select(orchestrate.planned_workers(F.col("ms"), cap)).collect()] == [1, 6, 4, 2, 1]
    jobs = spark.createDataFrame([("a", "completed", 0), ("b", "failed", 0), ("c", "running", 0), ("d", "completed", 10**6)], "job_id string, status string, s long").withColumn("changed_at", F.timestamp_seconds("s"))
    now = F.timestamp_seconds(F.lit(10**6 + 5))
    assert {r["job_id"]: r["outcome"] for r in orchestrate.prune(jobs, now).collect()} == {"a": "remove", "b": "keep_failed", "c": "protect", "d": "recent"}
    assert orchestrate.prune(jobs, now, include_failed=True).where("outcome = 'remove'").count() == 2
    assert orchestrate.warm_up_mean([5, 6]) == 5 and orchestrate.warm_up_mean([]) == 0


def test_config():
    config = Config.load({"chunk_size": "x", "search_limit": 7, "llm_api_key": "k"}, {"LECTORIUM_SEARCH_LIMIT": "9", "LECTORIUM_EXTRACT_WORKERS": "-1"})
    assert (config.chunk_size, config.search_limit, config.extract_workers) == (500, 9, "auto")
    assert config.show()["llm_api_key"] == "***"
    assert S.pending_migrations([1]) == [2, 3] and S.pending_migrations([]) == [1, 2, 3]


def an_epub(chapters):
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        z.writestr("META-INF/container.xml", '<container xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="OEBPS/c.opf"/></rootfiles></container>')
        items = "".join(f'<item id="i{n}" href="p{n}.xhtml" media-type="application/xhtml+xml"/>' for n in range(len(chapters)))
        refs = "".join(f'<itemref idref="i{n}"/>' for n in reversed(range(len(chapters))))
        z.writestr("OEBPS/c.opf", f'<package xmlns:dc="http://purl.org/dc/elements/1.1/"><metadata><dc:title>Quiet Harbour</dc:title><dc:creator>A. N.</dc:creator></metadata><manifest>{items}<item id="ncx" href="t.ncx" media-type="application/x-dtbncx+xml"/></manifest><spine>{refs}</spine></package>')
        points = "".join(f"<navPoint><navLabel><text>Part {n}</text></navLabel></navPoint>" for n in range(len(chapters)))
        z.writestr("OEBPS/t.ncx", f"<ncx><docTitle><text>Q</text></docTitle><navMap>{points}</navMap></ncx>")
        for n, text in enumerate(chapters):
            z.writestr(f"OEBPS/p{n}.xhtml", f"<html><body><p>{text}</p></body></html>")
    return raw.getvalue()


def test_ingest_search_ask_delete(spark, tmp_path):
    (tmp_path / "books" / "sub").mkdir(parents=True)
    (tmp_path / "books" / "a.EPUB").write_bytes(an_epub(["The orchard stands still.", "A lantern in the harbour."]))
    (tmp_path / "books" / "sub" / "copy.epub").write_bytes(an_epub(["The orchard stands still.", "A lantern in the harbour."]))
    (tmp_path / "books" / "broken.epub").write_bytes(b"no zip")
    (tmp_path / "books" / "notes.txt").write_text("ignored")
    engine = Engine(spark, empty_library(spark), Config(chunk_size=60))
    path = str(tmp_path / "books")
    found = files.find_books(spark, path)
    assert found.count() == 3
    status = sorted((r["source_path"].rsplit("/", 1)[1], r["status"], r["quality"], r["chunks"]) for r in engine.ingest(path, tags=["t"]).collect())
    assert status == [("a.EPUB", "completed", "ok", 2), ("broken.epub", "skipped", "extract_failed", 0)]
    assert engine.tables["book"].first()["title"] == "Quiet Harbour" and engine.tables["book"].first()["tags"] == '["t"]'
    assert [r["title"] for r in catalog.chapters_of(engine.tables["chapter"], 1).collect()] == ["Part 0", "Part 1"]
    store = str(tmp_path / "store")
    engine.save(store)
    engine = Engine.open(spark, store, Config(chunk_size=60))
    asked = spark.createDataFrame([(1, "lantern harbour")], "query_id long, query string")
    for mode in ("fts", "vector", "hybrid"):
        best = engine.search(asked, 2, mode).orderBy("rank").first()
        assert "lantern" in best["body"]
    with pytest.raises(ValueError, match="unknown search mode"):
        engine.search(asked, 2, "keyword")
    assert len(engine.search_one("lantern harbour", 2)) == 2
    with pytest.raises(LookupError):
        Engine(spark, empty_library(spark)).search_one("lantern")
    assert {r["mode"] for r in engine.capture(asked, 2).collect()} == {"fts", "hybrid"}
    heard = {}

    def model(system, user):
        heard["user"] = user
        return "It is there."

    said = engine.ask("lantern harbour", model, expand=True)
    assert said["answer"] == "It is there." and said["total_ms"] >= said["retrieval_ms"] and said["sources"].startswith("Sources:\n[1] Quiet Harbour, Part") and heard["user"].endswith("Question: lantern harbour")
    assert engine.rebuild_binary() == 2
    before = [(r["chunk_id"], round(r["score"], 9)) for r in engine.search(asked, 5, "fts").orderBy("rank").collect()]
    engine.rebuild_lexical(str(tmp_path / "index"))
    assert engine.index.words.where("term = 'lantern'").count() == 1
    assert [(r["chunk_id"], round(r["score"], 9)) for r in engine.search(asked, 5, "fts").orderBy("rank").collect()] == before
    engine.export(str(tmp_path / "out"), "csv")
    assert spark.read.option("header", "true").csv(str(tmp_path / "out")).count() == 2
    assert engine.statistics().first()["missing"] == 0 and all(engine.health().values())
    engine.delete_book(1)
    assert engine.tables["chunk"].count() == 0 and engine.tables["chunk_vec"].count() == 0


def test_a_library_that_is_kept(spark, tmp_path):
    """Open, ingest, save, open, delete, save where it was opened, with the index following each change."""
    store, books = str(tmp_path / "store"), tmp_path / "books"
    books.mkdir()
    (books / "a.epub").write_bytes(an_epub(["The orchard stands still.", "A lantern in the harbour."]))
    (books / "broken.epub").write_bytes(b"no zip")
    engine = Engine.open(spark, store, Config(chunk_size=60))
    engine.ingest(str(books))
    engine.rebuild_lexical(str(tmp_path / "first"))
    engine.save(store)
    (books / "b.epub").write_bytes(an_epub(["A second lantern burns.", "索引はカタログの品質を説明する"]))
    engine = Engine.open(spark, store, Config(chunk_size=60))
    engine.ingest(str(books))
    engine.save(store)
    engine = Engine.open(spark, store, Config(chunk_size=60))
    asked = spark.createDataFrame([(1, "lantern"), (2, "品質")], "query_id long, query string")
    assert sorted((r["query_id"], r["book_id"]) for r in engine.search(asked, 5, "fts").collect()) == [(1, 1), (1, 2), (2, 2)]

    def scores():
        return sorted((r["query_id"], r["chunk_id"], round(r["score"], 6)) for r in engine.search(asked, 5, "fts").collect())

    kept, upheld = scores(), engine.index
    engine.index = None
    assert scores() == kept  # as without an index
    engine.index = upheld
    log = [(r["status"], r["book_id"]) for r in engine.tables["ingest_log"].orderBy("log_id").collect()]
    assert sorted(log, key=str) == [("completed", 1), ("completed", 2), ("failed", None), ("failed", None)]
    engine.delete_book(1)
    engine.save(store)
    engine = Engine.open(spark, store, Config(chunk_size=60))
    assert {r["book_id"] for r in engine.search(asked, 5, "fts").collect()} == {2}
    kept, upheld = scores(), engine.index
    engine.index = None
    assert scores() == kept
    engine.index = upheld
    report = {r["check"]: r["passed"] for r in engine.doctor().collect()}
    assert report.pop("no file failed") is False and all(report.values()), report
    assert "2 chunks" in " ".join(r["line"] for r in engine.inspect(2).collect()) or engine.inspect(2).count() == 2
    assert engine.inspect().count() == 1 and "characters" in engine.inspect(chunk_id=engine.tables["chunk"].first()["chunk_id"]).first()["line"]
    assert len(list((tmp_path / "store").glob("v-*"))) == 2


def test_jobs_resume(spark, tmp_path):
    ranges = spark.createDataFrame([(1, 1, 2), (1, 3, 4), (2, 1, 1)], jobs.RANGES)
    seen = []

    def extract(broken):
        def read(left):
            seen.append(sorted(map(tuple, left.collect())))
            rows = left.withColumn("page_num", F.explode(F.sequence("page_start", "page_end")))
            bad = F.when((F.col("book_id") == 1) & (F.col("page_start") == 3) & F.lit(broken), F.lit("unreadable"))
            return rows.select("*", F.format_string("page %d of %d", "page_num", "book_id").alias("text"), bad.alias("error"))

        return read

    job = jobs.Job.open(spark, str(tmp_path), "j1", attempts=2, wait_s=0)
    assert job.run(ranges, extract(True)) is False and job.status == "failed" and job.failed[0]["error"] == "unreadable"
    assert seen == [[(1, 1, 2), (1, 3, 4), (2, 1, 1)], [(1, 3, 4)]]
    again = jobs.Job.open(spark, str(tmp_path), "j1", wait_s=0)
    assert again.pages().count() == 3 and again.run(ranges, extract(False)) and seen[2:] == [[(1, 3, 4)]]
    assert [(r["book_id"], r["page_num"], r["text"]) for r in again.pages().orderBy("book_id", "page_num").collect()] == [(1, n, f"page {n} of 1") for n in (1, 2, 3, 4)] + [(2, 1, "page 1 of 2")]
    assert jobs.Job.open(spark, str(tmp_path), "j1").run(ranges, extract(True)) and len(seen) == 3  # nothing is left
    assert jobs.Job.open(spark, str(tmp_path), "j1", reset=True).pages().count() == 0


def test_quality_is_graded_again_after_repair(spark):
    odd = "\u200b\u200b\u200b\u200bThe orchard stands."
    page = spark.createDataFrame([(1, n, odd) for n in range(4)] + [(2, n, odd) for n in range(4)] + [(3, 1, "Fine.")], S.PAGE)
    books = spark.createDataFrame([(1, "epub", "text_corrupt", "text_corrupt"), (2, "pdf", "text_corrupt", "text_corrupt"), (3, "epub", "ok", None)], "book_id long, book_format string, quality string, warning string")
    pages, graded = quality.repair_epubs(page, books)
    assert {r["book_id"]: (r["quality"], r["warning"]) for r in graded.collect()} == {1: ("ok", None), 2: ("text_corrupt", "text_corrupt"), 3: ("ok", None)}
    assert {r["text"] for r in pages.where("book_id = 1").collect()} == {"The orchard stands."} and pages.count() == 9


def test_embedding_batches(spark):
    stored = spark.createDataFrame([(1, [1.0]), (2, [2.0])], S.CHUNK_VEC)
    chunk = spark.createDataFrame([(1, "a"), (3, "a")], "chunk_id long, embedding_version string")
    vectors, chunks = knn.save_batch(stored, chunk, [1, 3], [[5.0], [6.0]], "m")
    assert {r[0]: r[1] for r in vectors.collect()} == {1: [5.0], 2: [2.0], 3: [6.0]} and {r[1] for r in chunks.collect()} == {"m"}
    with pytest.raises(ValueError):
        knn.save_batch(stored, chunk, [1], [], "m")
    with pytest.raises(ValueError):
        knn.save_batch(stored, chunk, [1], [[1.0]], "m", replace=False)
    assert [r["chunk_id"] for r in knn.delete(stored, stored.where("chunk_id = 1")).collect()] == [2]


def test_workers_and_hosts(spark):
    row = spark.createDataFrame([(3000, 8, 5), (3000, None, 1), (None, None, 9)], "ms long, cap int, left int")
    planned = [r[0] for r in row.select(orchestrate.workers("auto", F.col("ms"), F.col("cap"), F.col("left"))).collect()]
    fixed = [r[0] for r in row.select(orchestrate.workers("6", F.col("ms"), F.col("cap"), F.col("left"))).collect()]
    assert planned == [2, 1, 1] and fixed == [5, 1, 6]
    report = "hw.perflevel0.physicalcpu: 10\nhw.memsize: 34359738368\nMach Virtual Memory Statistics: (page size of 16384 bytes)\nPages free:      100.\nPages inactive:   50.\n"
    hosts = spark.createDataFrame([("a", report), ("b", "")], "host string, report string")
    assert [tuple(r) for r in orchestrate.observed_hosts(hosts).orderBy("host").collect()] == [("a", 10, 34359738368, 150 * 16384), ("b", None, None, None)]


def test_language_model_over_http():
    heard = []

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_POST(self):
            heard.append((self.headers["x-api-key"], json.loads(self.rfile.read(int(self.headers["Content-Length"])))))
            self.send_response(200)
            self.end_headers()
            self.wfile.write(json.dumps({"content": [{"type": "text", "text": "It "}, {"type": "text", "text": "is."}] if len(heard) == 1 else []}).encode())

        def log_message(self, *args):
            pass

    server = http.server.HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        model = connectors.HttpModel(f"http://127.0.0.1:{server.server_port}/v1/messages", "m", "key")
        assert model("system", "user") == "It is."
        assert heard[0] == ("key", {"model": "m", "max_tokens": 2048, "system": "system", "messages": [{"role": "user", "content": "user"}]})
        with pytest.raises(ValueError):
            model("system", "user")
    finally:
        server.shutdown()


def test_epub_navigation_document():
    nav = '<html xmlns="http://www.w3.org/1999/xhtml" xmlns:epub="http://www.idpf.org/2007/ops"><body><nav epub:type="landmarks"><ol><li><a href="x">Cover</a></li></ol></nav><nav epub:type="toc"><ol><li><a href="a">One <i>fine</i> day</a><ol><li><a href="b">Nested</a></li></ol></li><li><span>Two</span></li></ol></nav></body></html>'
    assert files.Epub._nav_titles(nav.encode()) == ["One fine day", "Nested", "Two"]
    assert files.Epub._nav_titles(b"<html><body/></html>") == []


def test_embedding_fallback(spark):
    def shaky(texts):
        if any("bad" in t for t in texts):
            raise RuntimeError("no")
        return [[float(len(t))] for t in texts]

    df = spark.createDataFrame([(1, "aa"), (2, "bad"), (3, None)], "chunk_id long, body string")
    assert {r["chunk_id"]: r["embedding"] for r in connectors.embed(df, shaky).collect()} == {1: [2.0], 2: None, 3: [0.0]}
    assert connectors.HashingEmbedder(8).one("Word") == connectors.HashingEmbedder(8).one("word")
    with pytest.raises(ValueError):
        connectors.answer(lambda s, u: " ", "", "")


def test_lines_and_renderings(spark, tmp_path):
    page = spark.createDataFrame([(1, 1, "ä\n"), (1, 2, None)], S.PAGE)
    exchange.write_lines(page, str(tmp_path / "x" / "p"))
    assert exchange.read_pages(spark, str(tmp_path / "x" / "p")).count() == 2
    with pytest.raises(ValueError):
        exchange.export(page, str(tmp_path / "y"), "xml")
    rows = spark.createDataFrame([(1, 1, 5, 0.5, "B", "C", "x" * 400)], "query_id long, rank int, chunk_id long, score double, book_title string, chapter_title string, body string")
    (item,) = json.loads(exchange.results_json(rows).first()["results"])
    assert item["preview"] == "x" * 300 and item["chapter"] == "C"
    assert exchange.results_text(rows).first()["line"] == "1. [0.5000] B, C\n   " + "x" * 150 + "..."


def test_stream(spark, tmp_path):
    kind = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("ingested_at", T.TimestampType())])
    rows = spark.createDataFrame([(1, "one\n\ntwo"), (2, None), (3, "one\n\ntwo")], "doc_id long, text string").withColumn("ingested_at", F.current_timestamp())
    rows.write.parquet(str(tmp_path / "in"))
    documents = stream.read_documents(spark, str(tmp_path / "in"), kind)
    query = stream.write_chunks(stream.chunks_of(documents), str(tmp_path / "chunks"), str(tmp_path / "post"), str(tmp_path / "cp"))
    query.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "chunks")).count() == 2
    assert spark.read.parquet(str(tmp_path / "post")).where("term = 'two'").count() == 2
    unique = stream.deduplicated(stream.read_documents(spark, str(tmp_path / "in"), kind)).writeStream.format("memory").queryName("u").trigger(availableNow=True).start()
    unique.awaitTermination(120)
    assert spark.table("u").where("text is not null").count() == 1


def test_read_scans(spark):
    df = spark.createDataFrame([(1, "text", b"i"), (2, " ", b"ab"), (3, None, b"x" * 70), (4, "", None)], "page_num int, text string, image binary")

    def fast(image):
        return [image.decode()]

    def accurate(image):
        return [image.decode() * 3]

    got = {r["page_num"]: r for r in connectors.read_scans(df, fast, accurate).collect()}
    assert [got[i]["text"] for i in (1, 2, 3, 4)] == ["text", "ababab", "x" * 70, ""]
    assert (got[2]["ocr_retries"], got[3]["ocr_retries"], got[3]["ocr_fast_pages"], got[1]["ocr_pages"]) == (1, 0, 1, 0)
    once = {r["page_num"]: r["text"] for r in connectors.read_scans(df, fast, accurate, "accurate-only").collect()}
    assert once[2] == "ababab" and once[3] == "x" * 210
    assert {r["text"] for r in connectors.read_scans(df, fast, accurate, "never").collect()} == {"text", " ", ""}
    with pytest.raises(ValueError):
        connectors.read_scans(df, fast, accurate, "maybe")


def test_command_model_and_folders(spark, tmp_path):
    assert connectors.CommandModel(["cat"])("sys", "user") == "sys\n\nuser"
    for name, size in (("a/x", 3), ("a/b/y", 4), ("c/z", 5)):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"1" * size)
    assert {r["folder"]: (r["files"], r["bytes"]) for r in files.folder_sizes(spark, str(tmp_path)).collect()} == {"a": (2, 7), "c": (1, 5)}


def test_sql_functions(spark):
    from lectorium.functions.python_udfs import register

    register(spark)
    text = "\n\n".join("漢字。" * n for n in (3, 9, 2, 30))
    df = spark.createDataFrame([(1, text), (2, None), (3, "")], "i int, text string")
    df.createOrReplaceTempView("texts_of_test")
    sql = sorted(tuple(r) for r in spark.sql("select t.i, c.chunk_order, c.body, c.char_count from texts_of_test t, lateral chunk_text(t.text, 20, 5) c").collect())
    native = sorted((r["i"], r["chunk_order"], r["body"], r["char_count"]) for r in chunking.chunk_texts(df, "text", 20, 5).collect())
    assert sql == native and sql
    assert spark.sql("select nfkc('ｆ'), normalize_title(' Ａ ')").first()[:] == ("f", "a")


def test_first_titles(spark):
    rows = spark.createDataFrame([(1, r, t) for r, t in enumerate(["b", "a", "b", "c", "d", "e"], 1)], "query_id long, rank int, book_title string")
    assert evaluate.first_titles(rows).first()["titles"] == ["b", "a", "c", "d"]
