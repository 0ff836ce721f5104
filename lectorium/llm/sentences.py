"""Sentence boundaries in many languages and scripts, as SQL expressions only.

Terminators that end no sentence (in decimals, URLs, initials, abbreviations, brackets, quotations that go on)
are masked by private-use characters, one for one, so that all offsets stay as they are. What is left is cut by a
pattern of the terminators of all scripts, and the original text is restored by the offsets of the pieces. Long
texts are first cut at blank lines, which always end a sentence, and offsets are added up group by group, so that
the work grows with the length of a text and not with its square.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Abbreviations after which a sentence goes on whatever follows, by language, in natural order.
ABBREVIATIONS = {
    "en": "approx ca cf Ch ch Dr Ed ed Eq eq Fig fig Figs figs Gen Gov Hon Jr Lt Messrs Mr Mrs Ms Mt No no Nos nos p pp Prof Rep Rev Sec sec Sen Ser ser Sgt St Vol vol Vols vols vs",
    "de": "Abb Abs Abt Art Aufl Bd bzw evtl ggf Hr Fr Hrsg Kap Nr Prof S s sog St Str Tab u usf v vgl Vgl z Zt",
    "fr": "M MM Mme Mmes Mlle Me art av chap coll fig p vol",
    "es": "Sr Sra Srta Dr Dra D Da art cap fig núm pág págs Ud Uds vol",
    "pt": "Sr Sra Dr Dra art cap fig núm pág págs Prof Profa séc vol",
    "it": "Sig Dott Prof art cap fig pag vol",
    "nl": "dhr mevr blz nr",
    "ru": "г гг гл д ул им ил кн млн млрд напр п пп проф ред рис с см ср стр т табл тов тыс",
    "el": "αρ βλ κ κα σ σελ τ τόμ",
    "hi": "डॉ श्री प्रो पृ सं",
    "ar": "د أ م ص ج",
}
#: Months after a day's number and a full stop.
MONTHS = "Januar Jänner Februar März April Mai Juni Juli August September Oktober November Dezember"
#: Words by which a Chinese sentence goes on after a quotation.
CHINESE_SAYING = "问 問 说 說 道 答 喊 写道 寫道 表示"

CLOSERS = "[\"'”’»›)\\]}」』）】》〉〕］｣]"
OPENERS = "[\"'“‘«‹„(\\[{「『（【《〈〔［｢¿¡]"
ENDS = ".!?…。！？｡．؟۔।॥\u037e;"
CJK_ENDS = "。！？｡"
SPACE = "[\\s\\u00a0\\u2000-\\u200a\\u202f\\u3000]"
#: The private-use characters that stand for a masked full stop, and for any other masked terminator.
HIDDEN_STOP, HIDDEN_END = "\ue000", "\ue001"
CJK = "\\p{IsHan}\\p{IsHiragana}\\p{IsKatakana}ー々"


def _hide(text: Column, before: str, ends: str, after: str) -> Column:
    """Masks each of `ends` that stands between the patterns `before` (a look-behind, or '') and `after`.

    The terminator is matched first and what stands before it then, as looking behind at every character is slow.
    """

    def pattern(sign: str) -> str:
        return f"{sign}{before[:4]}(?:{before[4:-1]}){sign}){after}" if before else f"{sign}{after}"

    if "." in ends:
        text = F.regexp_replace(text, pattern("[.]"), HIDDEN_STOP)
        ends = ends.replace(".", "")
    return F.regexp_replace(text, pattern(f"[{ends}]"), HIDDEN_END) if ends else text


#: The private-use character that stands for the line break before a blank line, which no bracket goes beyond.
_PARAGRAPH = "\ue002"
_BRACKETS = "()（）「」『』"


def _span(opening: str, closing: str, depth: int = 4) -> str:
    """Java pattern of a balanced span within a paragraph, of any length, with spans of its kind nested to `depth`."""
    within = f"[^{opening}{closing}{_PARAGRAPH}]*+"
    inner = f"(?:{_span(opening, closing, depth - 1)}{within})*+" if depth > 1 else ""
    return f"[{opening}]{within}{inner}[{closing}]"


def _hide_spans(text: Column) -> Column:
    """Masks the terminators in brackets and corner quotes; one just before the closing sign only in full-width brackets.

    A closing sign whose opening one isn't there closes what stands before it: up to the last bracket, in the same
    line for round brackets, else in the paragraph; so do texts that begin within brackets.
    """
    hidden, cjk_hidden = "".join(HIDDEN_STOP if e == "." else HIDDEN_END for e in ENDS), HIDDEN_END * len(CJK_ENDS)
    text = F.regexp_replace(text, "\\n(?=[ \\t\\r\\f\\x0b\\u00a0\\u2000-\\u200a\\u202f\\u3000]*\\n)", _PARAGRAPH)
    spans = "|".join(_span(a, b) for a, b in ("()", "（）", "「」", "『』"))
    pieces = F.regexp_extract_all(text, F.lit(f"(?s){spans}|[^{_BRACKETS}\n{_PARAGRAPH}]*+[)]|[^{_BRACKETS}{_PARAGRAPH}]*+[）」』]|[^{_BRACKETS}]++|."), F.lit(0))

    def hide(piece: Column) -> Column:
        closing, most = F.right(piece, F.lit(1)), F.length(piece) - 2
        last = F.substring(piece, most + 1, F.lit(2))
        return (
            F.when(most < 0, piece).when(closing == ")", F.concat(F.translate(F.substring(piece, F.lit(1), most), ENDS, hidden), last))
            .when(closing == "）", F.translate(piece, CJK_ENDS, cjk_hidden)).when(closing.isin("」", "』"), F.concat(F.translate(F.substring(piece, F.lit(1), most), CJK_ENDS, cjk_hidden), last)).otherwise(piece)
        )

    return F.translate(F.array_join(F.transform(pieces, hide), ""), _PARAGRAPH, "\n")


def mask(text: Column) -> Column:
    """`text` with every terminator that ends no sentence replaced by one private-use character each."""
    closers = f"{CLOSERS}{{0,4}}"
    names = "|".join(sorted({w for words in ABBREVIATIONS.values() for w in words.split()}, key=len, reverse=True))
    # decimals, versions, file names, hosts, and the inside of a.m., e.g., z.B.
    text = _hide(text, "(?<=[\\p{L}\\p{M}\\p{N}])", ".", "(?=[\\p{Ll}\\p{Lo}\\p{N}])")
    text = _hide(text, "(?<=[\\p{L}\\p{N}/])", "?!", "(?=[a-z0-9=&/])")
    # a stop before a comma, a dash or a small letter goes on; so do quotations and brackets closed there
    text = _hide(text, "", ".!?…", f"(?=[.!?…]{{0,4}}{SPACE}?{closers}{SPACE}*[,:–—-])")
    text = _hide(text, "", ".!?…", f"(?=[.!?…]{{0,4}}{SPACE}?{closers}(?:{SPACE}(?!{SPACE}*\\n{SPACE}*\\n))+{OPENERS}?\\p{{Ll}})")
    text = _hide(text, "", ".!?…", f"(?=[.!?…]{{0,4}}{closers}[\\p{{Ll}}])")
    # initials, abbreviations and days
    text = _hide(text, "(?<=(?:^|[^\\p{L}\\p{M}\\p{N}])\\p{Lu})", ".", f"(?={SPACE}*[\\p{{L}}\\p{{N}}])")
    text = _hide(text, f"(?<=(?:^|[^\\p{{L}}\\p{{M}}\\p{{N}}])(?:{names}))", ".", f"(?={SPACE}{{0,3}}[^\\s])")
    text = _hide(text, "(?<=(?:[\\p{L}][\\ue000] ?\\p{L}))", ".", f"(?={SPACE}{{1,3}}[\\p{{Lu}}\\p{{N}}](?<![aApP][\\ue000] ?[mM][.]{SPACE}{{1,3}}.))")
    text = _hide(text, "(?<=[0-9])", ".", f"(?={SPACE}{{1,3}}(?:{'|'.join(MONTHS.split())})\\b)")
    # inside brackets and corner quotes, of whatever length
    text = _hide_spans(text)
    # quotations after which the sentence goes on
    saying = "|".join(CHINESE_SAYING.split())
    text = _hide(text, "", CJK_ENDS, f"(?=[。！？｡]*[”’」』][^，。！？、“”「」]{{0,12}}(?:{saying}))")
    text = _hide(text, "", CJK_ENDS, "(?=[。！？｡]*[」』”][とっをがはにもの、，])")
    # an ellipsis within running CJK text; a semicolon that is no Greek question mark
    text = _hide(text, "", "…", f"(?=…*[{CJK}])")
    return _hide(text, "(?<![\\p{IsGreek}][»”)]?)", "\u037e;", "")


#: Thai has no stop: a blank ends a sentence unless a digit stands beside it.
_THAI_BREAK = f"(?={SPACE}+[^\\s0-9๐-๙])(?<=[\\p{{IsThai}}]{CLOSERS}{{0,2}})"


def sentence_pattern() -> str:
    """Java pattern whose consecutive matches are the sentences of a masked text, each with the blanks before it."""
    stop = f"[{ENDS}]+(?:{SPACE}?[»›])?{CLOSERS}*"
    ends = "|".join([
        f"{stop}(?={SPACE}|\\z)",
        f"[{CJK_ENDS}]+{CLOSERS}*",
        f"[.!?…](?<=[\\p{{Ll}}\\p{{M}}\\p{{N}})%\\ue000][.!?…])[.!?…]*{CLOSERS}*(?={OPENERS}?\\p{{Lu}})",
        f"[।॥؟۔]+{CLOSERS}*",
        f"(?={SPACE}*\\n{SPACE}*\\n)",
        _THAI_BREAK,
        f"(?={SPACE}*\\z)",
    ])
    return f"(?s){SPACE}*[^\\s\\u00a0\\u2000-\\u200a\\u202f\\u3000].*?(?:{ends})"


#: Characters from which on a text is cut at its next blank line, and sentences whose offsets are added up at once.
BLOCK, GROUP = 8_192, 256


def _running(array: Column, start: Column, add) -> Column:
    """Array of the sums before each element, and of all at its end."""
    return F.aggregate(array, F.array(start), lambda done, x: F.concat(done, F.array(add(F.element_at(done, -1), x))))


def sentence_marks(text: Column) -> Column:
    """Array of (length, is_sentence) that make up the text: its sentences, each with the blanks before it, and what is left."""
    blocks = F.regexp_extract_all(text, F.lit(f"(?s).{{{BLOCK},}}?\\n[ \\t\\r]*\\n|.+"), F.lit(0))

    def marks(block: Column) -> Column:
        pieces = F.transform(F.regexp_extract_all(mask(block), F.lit(sentence_pattern()), F.lit(0)), lambda p: F.struct(F.length(p).alias("length"), F.lit(True).alias("is_sentence")))

        def whole(own: Column) -> Column:
            rest = F.length(block) - F.aggregate(own, F.lit(0), lambda n, p: n + p["length"])
            return F.concat(own, F.array(F.struct(rest.alias("length"), F.lit(False).alias("is_sentence"))))

        return F.transform(F.array(pieces), whole)[0]  # bound by a lambda, as else the pieces would be matched twice

    return F.flatten(F.transform(blocks, marks))


def sentences(df: DataFrame, id_column: str = "chunk_id", text_column: str = "body") -> DataFrame:
    """(id, sentence_no, sentence_start, sentence_end, sentence) for each sentence of each text.

    The sentences of a text, with the blanks between them, make up the whole text. Null, empty and blank texts
    have no sentence; a text without a terminator is one sentence; a repeated row repeats its sentences; other
    columns of `df` are ignored. Offsets count code points.
    """
    marked = df.select(F.col(id_column), F.col(text_column).cast("string").alias("_text")).withColumn("_marks", sentence_marks(F.col("_text")))
    groups = F.when(F.size("_marks") > 0, F.transform(F.sequence(F.lit(0), F.floor((F.size("_marks") - 1) / GROUP).cast("int")), lambda g: F.slice("_marks", g * GROUP + 1, F.lit(GROUP))))
    sums = F.transform(groups, lambda g: F.aggregate(g, F.struct(F.lit(0).alias("at"), F.lit(0).alias("no")), lambda n, m: F.struct((n["at"] + m["length"]).alias("at"), (n["no"] + m["is_sentence"].cast("int")).alias("no"))))
    starts = _running(sums, F.struct(F.lit(0).alias("at"), F.lit(0).alias("no")), lambda n, x: F.struct((n["at"] + x["at"]).alias("at"), (n["no"] + x["no"]).alias("no")))
    # outer explodes, as else a filter on the array's size would be inferred and pushed below joins, matching everything twice
    parts = marked.withColumn("_groups", groups).withColumn("_starts", starts).select(id_column, "_text", F.posexplode_outer("_groups").alias("_g", "_group"), "_starts")
    first, after = F.element_at("_starts", F.col("_g") + 1), F.element_at("_starts", F.col("_g") + 2)
    parts = parts.where("_group is not null").select(id_column, "_group", first.alias("_first"), F.substring("_text", first["at"] + 1, after["at"] - first["at"]).alias("_part"))
    ends = _running(F.col("_group"), F.lit(0), lambda at, m: at + m["length"])
    # a group has at most one piece for each block that is no sentence, so sentences are numbered among those before them
    numbers = _running(F.col("_group"), F.lit(0), lambda no, m: no + m["is_sentence"].cast("int"))
    each = F.zip_with(F.zip_with("_group", ends, lambda m, at: F.struct(m["length"].alias("length"), m["is_sentence"].alias("is_sentence"), at.alias("at"))), numbers, lambda m, no: F.struct(m["length"].alias("length"), m["is_sentence"].alias("is_sentence"), m["at"].alias("at"), no.alias("no")))
    spans = parts.select(id_column, "_first", "_part", F.explode_outer(each).alias("_m")).where("_m.is_sentence")
    piece = F.substring("_part", F.col("_m.at") + 1, F.col("_m.length"))
    trimmed = F.regexp_replace(piece, f"^{SPACE}+", "")
    end = F.col("_first.at") + F.col("_m.at") + F.col("_m.length")
    return spans.select(id_column, (F.col("_first.no") + F.col("_m.no")).alias("sentence_no"), (end - F.length(trimmed)).alias("sentence_start"), end.alias("sentence_end"), trimmed.alias("sentence"))
