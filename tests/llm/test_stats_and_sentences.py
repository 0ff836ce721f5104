import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lectorium.llm import sentences as SE
from lectorium.llm import text_stats as TS

PIECES = st.lists(st.sampled_from(["word ", "the", "a, b", ".", "\n", " ", "漢字", "12", "|", "\t", "x=1 ", "→", "- ", ";y", "  z", "Ä", "é́"]), max_size=40).map("".join)


@settings(max_examples=300, deadline=None)
@given(PIECES, st.lists(st.integers(0, 200), max_size=5))
def test_parts_merge_to_the_whole(text, cuts):
    """Cut anywhere and merged in any grouping, the totals that make the figures are those of the whole."""
    cuts = sorted({c for c in cuts if c < len(text)})
    parts = [text[a:b] for a, b in zip([0, *cuts], [*cuts, len(text)])]
    states = [TS.state_of(p) for p in parts]
    left = None
    for s in states:
        left = TS.merge(left, s)
    right = None
    for s in reversed(states):
        right = TS.merge(s, right)
    whole = TS.totals_of(TS.state_of(text))
    assert TS.totals_of(left) == TS.totals_of(right)
    assert TS.totals_of(left)[TS.CHARS] == whole[TS.CHARS] and TS.totals_of(left)[TS.LINES] == whole[TS.LINES]
    assert TS.totals_of(left)[TS.WORDS] == whole[TS.WORDS] and TS.totals_of(left)[TS.WORD_CHARS] == whole[TS.WORD_CHARS]
    assert TS.totals_of(left)[TS.COMMONS] == whole[TS.COMMONS]


def verdict(text):
    return TS.verdict(TS.totals_of(TS.state_of(text)))[1]


def test_verdicts():
    assert verdict("The quiet harbour was there. It had been so for years, and nobody asked why.")
    assert verdict("Документ описывает словарь\nОднако сборник после проверки описывает указатель\nКаталог проверяет список в старом издании")
    assert verdict("ノートが見出しを整理した\nそれでも、司書とこの章が語順を説明している")
    assert not verdict("\n".join(f"{w}, {i}, {i + 4}" for i, w in enumerate(["harbour", "orchard", "lantern", "margin"])))
    assert not verdict("| a | b |\n|---|---|\n| harbour | 12.5% |\n| orchard | 7 |")
    assert not verdict("well-known paragraph\nsmall volume\nscanner\nsimple ledger")
    assert not verdict("Chapter 1. Harbour ............ 3\nChapter 2. Orchard ............ 12")
    assert not verdict("2025-01-01 10:00:01 INFO pages=3 ms=12\n2025-01-01 10:00:02 WARN pages=4 ms=9")
    assert verdict("") is None and verdict(" \n ") is None


def test_statistics_table(spark):
    long = "The harbour was quiet. " * 6000  # above a segment
    rows = [("f", 1, "One word.\nTwo words"), ("f", 2, None), ("f", 3, ""), ("f", 4, " \n"), ("f", 5, long), ("f", 1, "One word.\nTwo words")]
    df = spark.createDataFrame(rows, "field string, row_id long, text string").withColumn("n_words", F.lit("clash")).withColumn("_text", F.lit(1))
    got = TS.text_statistics(df, ["field", "row_id"], "text").collect()
    by = {r["row_id"]: r for r in got}
    assert len(got) == 6 and by[2]["n_chars"] is None and by[3]["n_words"] == 0 and by[4]["is_prose"] is None
    assert (by[1]["n_words"], by[1]["n_lines"], by[1]["ended_line_share"]) == (4, 2, 0.5)
    whole = TS.figures(TS.totals_of(TS.state_of(long)))
    assert tuple(by[5][c.split()[0]] for c in TS.COLUMNS.split(", "))[:3] == whole[:3] and by[5]["is_prose"]
    assert TS.text_statistics(df.limit(0), ["field", "row_id"], "text").count() == 0


def test_long_row_delivered_twice(spark):
    long = "The harbour was quiet\n" * 3000 + "| a | 12 |\n" * 60_000  # many segments
    df = spark.createDataFrame([("f", 1, long), ("f", 1, long), ("f", 2, long)], "field string, row_id long, text string")
    got = {r["row_id"]: r[2:] for r in TS.text_statistics(df, ["field", "row_id"], "text").collect()}
    whole = TS.figures(TS.totals_of(TS.state_of(long)))
    assert got[1] == got[2] and got[1][:3] == whole[:3]


def ends(spark, text):
    df = spark.createDataFrame([(1, text)], "chunk_id long, body string")
    return [r["sentence"] for r in SE.sentences(df).orderBy("sentence_no").collect()]


CASES = [
    ["Dr. A. B. Quandt costs approx. 1,220.50 crowns, i.e. more.", "See notes.txt and notes.example/vol6.html today.", "It ends at 7 a.m.", "Then Nr. 5 comes."],
    ["“Why?” and “How?” are here.", "“Is it done yet?” asked Ines.", "Tibor wrote: “This works.”", "The lantern (it never stops!) is on."],
    ["Am 2. Mai prüft Nr. 8 das Buch usw. und den Rücken!", "Laut Dr. Selma stimmt es, z. B. auf S. 33.", "„Ist es so?“, fragte Yara."],
    ["« Est-ce que le lecteur répond ? » demanda Tibor.", "Le sommaire... ou plutôt la marge.", "Voir chap. 6, p. 32."],
    ["«Где же том?» — спросил редактор.", "Том, т. е. рис. 8, открыт и т. д. каждую неделю."],
    ["¿Ya está?", "¡El Sr. Ruvik midió el diseño, p. ej., en la pág. 66!"],
    ["ओर का पाठ है।", "क्या पाठ है?"], ["لماذا يكرر القارئ 3.41 من النص؟", "يقول د. سامر ذلك."], ["Γιατί όχι;", "Το ευρετήριο, π.χ. στη σελ. 27, είναι εδώ."],
]
JOINED = [["索引（第3版。改訂済み）は本文を置き換えた。", "「目録は見つかりましたか。」と司書が尋ねた。", "「索引が補う。」", "リストは整理した……と書いてある。"], ["“编辑找到了吗？”读者问道，索引省略了语序。", "管理员……其实整理了引文！"]]


def test_sentences_in_many_scripts(spark):
    for case in CASES:
        assert ends(spark, " ".join(case)) == case
    for case in JOINED:
        assert ends(spark, "".join(case)) == case
    assert ends(spark, "สารบัญแก้ไข 4.41 เท่า ผู้อ่านเรียงลำดับ\nบทใหม่") == ["สารบัญแก้ไข 4.41 เท่า", "ผู้อ่านเรียงลำดับ", "บทใหม่"]
    assert ends(spark, "No stop here\n\nNext paragraph cut off in") == ["No stop here", "Next paragraph cut off in"]
    assert ends(spark, "Broken line\nis one. Glued.Next one") == ["Broken line\nis one.", "Glued.", "Next one"]


def test_long_brackets_and_quotations(spark):
    long = "It stops here. It goes on. " * 20
    for case in (["The lantern (" + long + "so it is) is on.", "Next one."], ["The lantern (it stops.\nIt goes on) is on.", "Next one."], ["A lantern (one. Two (three. Four) five. Six) is on.", "Next one."]):
        assert ends(spark, " ".join(case)) == case
    long = "索引が補う。" * 80
    for case in (["目録（" + long + "改訂）は本文を置き換えた。", "次の文。"], ["司書は「" + long + "はい」と尋ねた。", "次の文。"], ["司書は『" + long + "はい』と尋ねた。", "次の文。"]):
        assert ends(spark, "".join(case)) == case
    # an open bracket or quotation without its end doesn't reach beyond its paragraph
    assert ends(spark, "It is (open. And on.\n\nNext) one. Last.") == ends(spark, "It is (open. And on.") + ends(spark, "Next) one. Last.")
    assert ends(spark, "(" * 20_000 + "a. B" + "「" * 20_000)[0] == "(" * 20_000 + "a."


def test_sentences_lose_nothing(spark):
    rng = random.Random(8)
    texts = ["".join(rng.choice(["A", "b", ". ", "! ", "。", "」", "”", "\n", "\n\n", " ", "1.", "(", ")", "…", "？", "ก", "ä"]) for _ in range(rng.randrange(40))) for _ in range(200)]
    texts += [None, "", "  \n", "😀" * 50 + ". X", "a" * 200_000]
    df = spark.createDataFrame(list(enumerate(texts)), "chunk_id long, body string").withColumn("sentence", F.lit(1))
    got = {}
    for r in SE.sentences(df).orderBy("chunk_id", "sentence_no").collect():
        got.setdefault(r["chunk_id"], []).append(r)
    for i, text in enumerate(texts):
        at = 0
        for r in got.get(i, []):
            assert not text[at : r["sentence_start"]].strip() and text[r["sentence_start"] : r["sentence_end"]] == r["sentence"] and r["sentence"].strip() == r["sentence"]
            at = r["sentence_end"]
        assert not (text or "")[at:].strip()
    assert SE.sentences(df.limit(0)).count() == 0


def test_long_texts_are_cut_as_short_ones(spark):
    """Blank lines, groups of many sentences and brackets of any length; the sentences make up the text."""
    inside = "word. Other word! " * 400
    texts = [
        "One is here. " * 700 + "\n\n" + "Two is there. " * 900 + "\n \n\nThree (" + inside + "end) goes on. Four.", f"{inside}) as it began. Then more.", "「" + "文。" * 800 + "」と言った。次。", "文。" * 700 + "」と言った。次。",
        "a" * 20_000, " \n\n \n", "Ends here.\n\n\n\n", "\n\n😀 One. 😀 Two.",
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "chunk_id long, body string")
    got = {}
    for r in SE.sentences(df).orderBy("chunk_id", "sentence_no").collect():
        got.setdefault(r["chunk_id"], []).append(r)
    for i, rows in got.items():
        assert [r["sentence_no"] for r in rows] == list(range(len(rows)))
        assert all(texts[i][r["sentence_start"] : r["sentence_end"]] == r["sentence"] for r in rows)
        assert texts[i].split() == " ".join(r["sentence"] for r in rows).split() or i in (2, 3)
    assert {i: len(rows) for i, rows in got.items()} == {0: 700 + 900 + 2, 1: 2, 2: 2, 3: 2, 4: 1, 6: 1, 7: 2}
