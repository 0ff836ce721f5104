import random
import unicodedata

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lectorium.llm import lookalike as L
from lectorium.llm import mojibake as M

SAME = [
    ("Ｆｕｌｌ－ｗｉｄｔｈ　１２", "Full-width 12"), ("ﾃﾞｰﾀﾍﾞｰｽ", "データベース"), ("ﾃ­ﾞｰﾀ", "データ"), ("ﬁne ﬂow oﬀ", "fine flow off"), ("café", "café"), ("a​b⁠c﻿", "abc"),
    ("a b c　d", "a b c d"), ("Βinding Wοrkboοk", "Binding Workbook"), ("Kelvin Å", "Kelvin Å"), ("non‑breaking", "non-breaking"), ("τι;", "τι;"),
]
OTHER = [("Part 1045", "Part ¹045"), ("Case", "case"), ("resume", "résumé"), ("end.", "end!"), ("a b", "ab"), ("x…", "x."), ("½", "1/2"), ("ß", "ss")]


def test_looks():
    for a, b in SAME:
        assert L.skeleton(a) == L.skeleton(b), (a, b)
    for a, b in OTHER:
        assert L.skeleton(a) != L.skeleton(b), (a, b)


@settings(max_examples=400, deadline=None)
@given(st.text(max_size=30))
def test_forms_are_final(text):
    once = L.canonical(text)
    assert L.canonical(once) == once
    assert L.skeleton(once) == L.skeleton(text)
    assert L.canonical(unicodedata.normalize("NFD", once)) == L.canonical(unicodedata.normalize("NFC", once))


def test_scripts_stay():
    assert L.consistent("Каталог и порядок") == "Каталог и порядок"
    assert L.consistent("Wοrk Αθήνα") == "Work Αθήνα"
    assert L.canonical("क्‍ष") == "क्‍ष" and L.canonical("a‍b") == "ab"


def test_pairs_against_brute_force(spark):
    rng = random.Random(3)
    base = ["Quiet harbour 12", "café", "データ", "x"]
    rows = [(i, rng.choice([t, t.replace(" ", " "), unicodedata.normalize("NFD", t), t + "​"])) for i, t in enumerate(base * 12)] + [(100, None), (101, ""), (102, ""), (None, "x"), (3, "x")]
    df = spark.createDataFrame(rows, "book_id long, title string").withColumn("look", F.lit(1)).withColumn("own", F.lit(1)).withColumn("text", F.lit(1))
    known = [(i, t) for i, t in rows if i is not None and t]
    expected = {(a, b) for a, s in known for b, t in known if a < b and s != t and L.skeleton(s) == L.skeleton(t)}
    got = [tuple(r) for r in L.same_look_pairs(df, "book_id", "title").collect()]
    assert len(got) == len(set(got)) and set(got) == expected
    assert L.same_look_pairs(df.limit(0), "book_id", "title").count() == 0
    forms = {r["book_id"]: r["form"] for r in L.normalised(df, "book_id", "title").collect()}
    assert forms[100] is None and forms[101] == ""


TEXTS = [
    "Le résumé précède l’étagère, où l’éditeur décrit déjà la théorie à côté de l’entrée.", "Der Rücken prüft die Größe über den Winter für das Wörterbuch.", "¿Por qué la edición describió el catálogo? El diseño amplió la señal.",
    "Однако перечень после проверки описывает указатель, а редактор заменяет страницу.", "「編集者は見つかりましたか。」と検索結果が尋ねた。ロボットは要約を補っている。", "管理员补充了关键词，而译本重复了正文。目录解释了标题。", "“Why?” and “How?” are what it asks – naïvely, perhaps…",
    "يكرر القارئ الترجمة ويسبق الفهرس النص.", "ผู้อ่านเรียงลำดับหน้าสุดท้าย", "Η έκδοση διορθώνει τον κατάλογο με προσοχή.",
]
MODEL = M.train(TEXTS * 8)


def test_exact_round_trip_of_every_readable_chain():
    done = 0
    for chain in M.chains():
        for text in TEXTS:
            bad = M.garble(text, chain)
            if bad is not None and bad != text and "�" not in bad:
                assert M.restore(bad, chain) == (text, True)
                done += 1
    assert done > 100


def test_held_out_accuracy():
    held = ["La préface vérifie la numérisation après le déménagement, là où le relevé reprend.", "Der Schlüssel ergänzt während der Prüfung das Gedächtnis.", "Читатель каждую неделю проверяет сноску и порядок.", "目録がキーワードを繰り返す。静かな部屋で、索引は語順を置き換えた。"]
    found = exact = total = 0
    for right, wrong in (("utf-8", "cp1252"), ("utf-8", "latin-1"), ("utf-8", "cp850"), ("utf-8", "mac_roman"), ("utf-8", "cp1251")):
        for text in held:
            bad = M.garble(text, ((right, wrong),))
            got, made, _, _ = M.find(bad, MODEL)
            total += 1
            found += got
            exact += made == text
    assert found >= 0.95 * total and exact >= 0.8 * total


def test_clean_and_rare_letters_are_no_cases():
    for text in [*TEXTS, "ÂNCORA · ÂMBAR · SÃO VELMAR", "Ðórunn Þal, 3 µm, ¶ 7, ¿no?", "Åsa Ørnvik: £12 · 5 °C ± 0,5 · ½ × ¾ ©", "stray � here", "ctrl\x02char", "", "plain"]:
        assert not M.find(text, MODEL)[0], text


def test_garbled_table(spark):
    bad = M.garble(TEXTS[0], ((("utf-8", "cp1252")),))
    rows = [(1, bad), (2, TEXTS[0]), (3, None), (4, ""), (5, TEXTS[0] + "\n\n" + M.garble(TEXTS[3], (("utf-8", "cp1252"),)))] + [(100 + i, t) for i, t in enumerate(TEXTS * 6)]
    df = spark.createDataFrame(rows, "page_id long, text string").withColumn("chain", F.lit(1)).withColumn("id", F.lit(1))
    got = {r["page_id"]: r for r in M.garbled(df).collect()}
    assert sorted(got) == [1, 5]
    assert got[1]["restored"] == TEXTS[0] and got[1]["complete"] and got[5]["restored"] == TEXTS[0] + "\n\n" + TEXTS[3]
    assert M.garbled(df.limit(0)).count() == 0


def test_words_of_pages_outside_the_sample(spark):
    rare = [
        "Le forgeron désœuvré préférait l’éphémère à l’opéra, écœuré par la fièvre et l’évêché.", "La crémière égarée vénérait le sphéroïde, l’épée rouillée, la clé rêvée et l’orchidée.",
        "Le célèbre géomètre détestait la poésie, la dictée, le geste forcé et le musée.", "La comète dévêtue déréglait le réacteur, où le général fêtait l’été passé.",
        "Une sirène fatiguée répétait la mélopée, près du phénix pétrifié et du hérisson givré.", "Le téléphérique grinçait, déporté, près de la forêt brûlée et de l’abbaye isolée.",
    ]
    rare = [t.replace("œ", "e").replace("’", " ") for t in rare]
    bad = [M.garble(t, (("cp1252", "cp850"),)) for t in rare]
    rows = [(1 + i, t) for i, t in enumerate(bad)] + [(50 + i, t) for i, t in enumerate(rare)] + [(100 + i, t) for i, t in enumerate(TEXTS * 100 + TEXTS[:1] * 1_000)]  # much clean French, so that the garbled rows of the sample don't count for the classifier
    df = spark.createDataFrame(rows, "page_id long, text string")
    got = {r["page_id"]: r["restored"] for r in M.garbled(df, rows=500).collect()}
    assert got == {1 + i: t for i, t in enumerate(rare)}


def test_tables_of_long_texts_only(spark):
    clean = {i: "\n".join([TEXTS[i % 10]] * (1 + M.SAMPLE_CHARACTERS // len(TEXTS[i % 10]))) + "." * 100 for i in range(20)}
    bad = M.garble(TEXTS[0], (("utf-8", "cp1252"),)) + "\n" + clean[1]
    df = spark.createDataFrame([(100, bad), *clean.items()], "page_id long, text string")
    assert all(len(t) > M.SAMPLE_CHARACTERS for t in clean.values())
    pieces = M.sample(df, "page_id", "text")
    assert len(pieces) == 21 and all(len(t) == M.SAMPLE_CHARACTERS for t in pieces)
    assert [r["page_id"] for r in M.garbled(df).collect()] == [100]


def test_many_copies_pair_with_their_variants_only(spark, monkeypatch):
    monkeypatch.setattr(L, "LIST", 7)
    rows = [(i, "Harbour title") for i in range(300)] + [(1000 + i, "Harbour title") for i in range(20)] + [(2000, "Ｈarbour title"), (3000, "Other")]
    df = spark.createDataFrame(rows, "book_id long, title string")
    got = [tuple(r) for r in L.same_look_pairs(df, "book_id", "title").collect()]
    text = dict(rows)
    assert len(got) == len(set(got)) == 300 * 21 + 20
    assert all(a < b and text[a] != text[b] for a, b in got)
