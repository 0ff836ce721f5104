import random
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lectorium.functions import python_udfs as U
from lectorium.functions import terms as T
from lectorium.functions import text as X


def column(spark, values, make, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, t {kind}")
    return [r[1] for r in df.select("i", make(F.col("t"))).orderBy("i").collect()]


def test_clean_text(spark):
    cases = {
        "第\n一\n章": "第一章", "■ 第1章 概要": "第1章 概要", "段落A\n\n\n\n段落B": "段落A\n\n段落B", "行1\n　　　\n行2": "行1\n\n行2", "  hello  \n  world  ": "hello\nworld",
        "AB\nCD\nEF": "AB\nCD\nEF", "■●★": "", "": "", "abc\nd\nef": "abcd\nef",
    }
    assert column(spark, list(cases), X.clean_text) == list(cases.values())
    assert [U.cleaned(k) for k in cases] == list(cases.values())


def test_clean_text_equals_its_python_form(spark):
    rng = random.Random(4)
    texts = ["".join(rng.choice("ab \n\n\t■第　.") for _ in range(rng.randrange(30))) for _ in range(400)]
    assert column(spark, texts, X.clean_text) == [U.cleaned(t) for t in texts]


def test_paragraphs(spark):
    assert column(spark, ["A\n\n\nB", " a \n\n \n\n b", "", None], X.split_paragraphs) == [["A", "B"], ["a", "b"], [], None]


def test_repair():
    assert U.repaired("正常​テキスト�\u0000") == ("正常テキスト", True)
    assert U.repaired("���") == ("���", False)
    assert U.repaired("plain") == ("plain", False)
    assert U.repaired(None) == (None, False)


def test_repair_in_spark(spark):
    df = spark.createDataFrame([("正常​テキスト�\u0000",), (None,), ("",)], "t string")
    rows = [r["x"] for r in df.select(U.repair_text("t").alias("x")).collect()]
    assert (rows[0]["text"], rows[0]["changed"]) == ("正常テキスト", True)
    assert [r["changed"] for r in rows[1:]] == [False, False]


def test_corruption(spark):
    cases = {"a\x01\x02\x03b": True, "x" * 400 + "�": False, "word " * 30 + "�" * 2 + "a" + "�" * 8: True, "  \n ": False, "": False, None: False, "a\x01 \x02 \x03" + "b" * 500: False}
    assert column(spark, list(cases), X.looks_corrupt) == list(cases.values())


def brute_cut(text, n):
    return text.encode()[:n].decode(errors="ignore")


def test_cut_bytes(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choice("aé漢😀 ") for _ in range(rng.randrange(12))) for _ in range(300)]
    for n in (1, 2, 3, 5, 8):
        assert column(spark, texts, lambda c, n=n: X.cut_bytes(c, n)) == [brute_cut(t, n) for t in texts]
    assert column(spark, ["漢字漢字", "abc", None], lambda c: X.clipped(c, 4)) == ["漢...", "abc", None]
    assert column(spark, ["x" * 99], lambda c: X.clipped(c, 0)) == ["x" * 99]


def test_titles_and_formats(spark):
    df = spark.createDataFrame([("", "/a/b.c.PDF", "pdf"), ("Untitled ", "/x/y.epub", "epub"), ("Untitled", "/x/y.pdf", "pdf"), (None, "/n", "pdf")], "t string, p string, f string")
    rows = df.select(X.title_or_stem(F.col("t"), F.col("p"), F.col("f")), X.detect_format(F.col("p"))).collect()
    assert [tuple(r) for r in rows] == [("b.c", "pdf"), ("y", "epub"), ("Untitled", "pdf"), ("n", "")]


def test_html(spark):
    html = "<html><head><title>T</title><style>x{}</style></head><body><p>a &amp; b</p><!-- no --><script>1<2</script><ul><li> c</li></ul></body>"
    assert U.html_text(html) == "T\na & b\nc"
    assert column(spark, [html, None], lambda c: U.html_to_text(c)) == ["T\na & b\nc", None]


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=40))
def test_title_key_is_idempotent(text):
    assert U.title_key(U.title_key(text)) == U.title_key(text)
    assert U.title_key(text) == unicodedata.normalize("NFKC", text).strip().lower()


def test_terms(spark):
    assert column(spark, ["Café au lait!", "第1章 データ", None], T.words) == [["cafe", "au", "lait"], ["第", "1", "章", "データ"], None]
    assert column(spark, ["abcd", "ab"], T.trigrams) == [["abc", "bcd"], []]
    assert column(spark, ["索引とカタログ ab"], T.segments) == [["索引", "と", "カタログ", "ab"]]
    assert column(spark, ["a と", "索引 と x"], T.query_segments) == [["a", "と"], ["索引"]]
    assert column(spark, [" Ab abc  DEF "], T.trigram_terms) == [["abc", "def"]]


@pytest.mark.parametrize(("text", "term", "n"), [("aaaaaa", "aaa", 4), ("a.b.c", ".", 2), ("x\\Ey", "\\E", 1), ("", "a", 0)])
def test_occurrences(spark, text, term, n):
    df = spark.createDataFrame([(text, term)], "a string, b string")
    assert df.select(T.occurrences(F.col("a"), F.col("b"))).first()[0] == n


def test_intent_and_aliases(spark):
    queries = ["この二冊を比較したい", "What is the Difference of both?", "索引とは"]
    assert column(spark, queries, T.control_terms) == [["比較したい", "比較"], ["difference", "both"], []]
    assert column(spark, ["境界設計とテナント境界", "none"], T.expand_query) == ["境界設計とテナント境界 コンテキスト 境界づけられた 分離", "none"]
