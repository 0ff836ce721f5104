"""Pages of repeated keywords, lists of links and strings of product tags.

Bagged decision trees are trained on content and link features, from weak labels that rules of thumb give to clear
pages; then each page's prediction is smoothed by the rate of spam on its host.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectorium.llm.common import bounded_sample, checkpointed, in_parts

#: Weakly labelled rows of either label that the trees see at most: a documented bound; rows are chosen by their hashes.
TRAINING_ROWS = 8_000
TREES, DEPTH = 21, 8
#: Weight of the host's rate in a page's final score, and pages that a host's rate is drawn towards the overall rate by.
HOST_WEIGHT, HOST_PRIOR = 0.1, 20.0

FEATURES = (
    "length", "link_share", "tag_share", "tag_line_share", "sentence_share", "repeat_share", "row_share", "product_share", "distinct_words", "top_word_share",
    "repeated_pairs", "top_triple", "keyword_share", "sentence_rest", "links_per_sentence", "entropy", "word_length", "stops_per_word", "separators_per_word", "digit_share", "links_per_word", "line_links", "mark_share",
)

_URL = r"[!#-;=?-Z\\^-~]"  # plain characters without blanks, quotes, brackets
_LINK = re.compile(rf"<a\s[^>]{{0,400}}>|</a>|(?:h(?:tt|xx)ps?://|www\.){_URL}+(?:\[\.\]{_URL}*)*|(?<![\w@.])[A-Za-z0-9-]+(?:\.|\[\.\])[a-z]{{2,10}}(?:/{_URL}*)?(?![A-Za-z0-9.])")
_TAG = re.compile(r"(?<!\S)[#@][^\s#]+")
_LETTER_MARK = re.compile("[\u0300-\u036f\u064b-\u065f\u0900-\u0963\u0970-\u0dff\u0e31-\u0e4e]")
_SENTENCE_SIGNS = ".!?…。！？।؟"


def _tokens(marked: bool) -> re.Pattern[str]:
    """Words, and what ends a piece; where the text has no marks of letters, a plainer pattern will do."""
    letters = f"(?:[^\\W_]|{_LETTER_MARK.pattern})+" if marked else "[^\\W_]+"
    return re.compile(rf"{letters}(?:['’-]{letters})*|[{_SENTENCE_SIGNS}]+[\"'”’»)\]」』]*")


_TOKENS = {marked: _tokens(marked) for marked in (False, True)}
_STOP = re.compile(r"[.!?…。！？।؟;:](?=[\"'”’»)\]」』]*(?:\s|$))|[。！？।؟]")
_PIECE = re.compile(rf"[^{_SENTENCE_SIGNS}\n]*(?:[{_SENTENCE_SIGNS}]+[\"'”’»)\]」』]*|\n|$)")
_ROW = re.compile(r"\.{4,}\s*\d|(?:\b[\w.]+=\S+\s*){2}|^\s*[\w.]+\s?[:=]\s?\S{1,24}\s*$|^\s*(?:\d{4}[-/.]|\d{1,2}:\d\d|\d{4}\s)|\b(?:1[5-9]|20)\d\d\.\s*$")
#: What stands beside a product's name, in natural order.
PRODUCT_MARKS = "sku size pack pcs new sale deal discount off free cheap buy shipping price xl xxl"
_PRODUCT = re.compile(r"\bsize\s+\w{1,3}\b|\b\d+-?pack\b|[-−]\d{1,2}\s?%|[€$£]\s?\d|\b(?:" + "|".join(PRODUCT_MARKS.split()) + r")\b")  # of small letters
_PRODUCT_WORDS, _COMPOUND = frozenset(PRODUCT_MARKS.split()), re.compile("['’-]")
_ARTICLE = re.compile(r"\bsku\b|\bsize\s+\w{1,3}\b|\b\d+-?pack\b", re.IGNORECASE)
_SIGNS = "|/+·•→"  # separators by themselves
_COMMA, _DASH = re.compile(r"[,;](?=\s)"), re.compile(r"\s-\s")
_ODD_BLANK = re.compile(r"[^\S \n]")
_THAI = re.compile("[\u0e00-\u0e7f]")
_CJK = re.compile("[぀-ヿ㐀-鿿가-힣฀-๿]")


#: What every link, and every row, has something of; searching for that first spares most texts the full patterns.
_MAYBE_LINK = re.compile(r"\.[a-z]{2}|\[\.\]|</?a[\s>]|://|www\.")
_MARK = re.compile("[^\x00-\u2fff\u3040-\u30ff\u3400-\u9fff\uac00-\ud7a3\uff00-\uffef]")
_STOP_SIGNS = frozenset(".!?…。！？।؟;:")


def _solid(text: str) -> int:
    """Number of characters other than blanks."""
    return sum(map(len, text.split()))


def _separators(text: str, plain_blanks: bool) -> int:
    """Separators in a text: signs, commas and semicolons before a blank, dashes between blanks."""
    found = sum(map(text.count, _SIGNS))
    found += sum(map(text.count, (", ", ",\n", "; ", ";\n"))) if plain_blanks else len(_COMMA.findall(text))
    return found + (len(_DASH.findall(text)) if "-" in text else 0)


def _maybe_row(line: str) -> bool:
    end = line.rstrip()
    return "=" in line or ":" in line or "...." in line or line.lstrip()[:1].isdigit() or end[-1:] == "." and end[-2:-1].isdigit()


def _may_sell(text: str, words: Counter[str]) -> bool:
    """Whether a text without marks of letters has anything that stands beside a product's name."""
    if not _PRODUCT_WORDS.isdisjoint(words) or any(c in text for c in "%€$£") or "pack" in text.lower():
        return True
    return not _PRODUCT_WORDS.isdisjoint(part for w in words if not w.isalnum() for part in _COMPOUND.split(w))


def _pieces(tokens: list[str]) -> list[list[str]]:
    """The words of each piece of a line, of the matches of _TOKEN; one more than there are signs that end one."""
    made: list[list[str]] = []
    start = 0
    for i, t in enumerate(tokens):
        if t[0] in _SENTENCE_SIGNS:
            made.append(tokens[start:i])
            start = i + 1
    made.append(tokens[start:])
    return made


def _ended(piece: str) -> bool:
    end = piece.rstrip()[-4:]
    return end[-1:] in _STOP_SIGNS and end != "" or _STOP.search(end) is not None


def features(text: str) -> list[float]:
    """The features of one text; shares are of its characters other than blanks.

    Words are counted once for the whole text; a line that stands there several times is looked at once.
    """
    solid = max(1, _solid(text))
    links = _LINK.findall(text) if _MAYBE_LINK.search(text) else []
    rest = _LINK.sub(" ", text) if links else text
    tagged = "#" in text or "@" in text
    tags = _TAG.findall(rest) if tagged else []
    bare = _TAG.sub(" ", rest) if tags else rest
    marked = not text.isascii() and _LETTER_MARK.search(text) is not None
    token = _TOKENS[marked]
    lines = text.split("\n")
    seen: dict[str, tuple[str, str, list[list[str]]]] = {}
    words: list[str] = []
    for line in lines:
        if line not in seen:
            plain = _LINK.sub(" ", line) if links else line
            plain = _TAG.sub(" ", plain) if tags else plain
            low = plain.lower()
            seen[line] = plain, low, _pieces(token.findall(low))
        for piece_words in seen[line][2]:
            words += piece_words
    n = max(1, len(words))
    counts = Counter(words)
    pairs = Counter(zip(words, words[1:]))
    often = {p for p, c in pairs.items() if c > 2}
    repeated = sum(map(pairs.__getitem__, often))
    top_triple = 0.0
    if often:  # a triple is no more frequent than its pairs
        most = max(Counter(zip(words, words[1:], words[2:])).values(), default=0)
        top_triple = min(1.0, 3 * most / n) if most > 2 else 0.0
    several = {w for w, c in counts.items() if c > 1}
    entropy = 1.0 - sum(k * c * math.log2(c) for c, k in Counter(counts.values()).items()) / (n * math.log2(n)) if n > 1 else 1.0
    plain_script = text.isascii()
    plain_blanks = _ODD_BLANK.search(text) is None
    thai, cjk = (False, False) if plain_script else (_THAI.search(text), _CJK.search(text))
    products = marked or _may_sell(text, counts)

    sentence = repeat = keyword = row = product = line_links = stated = tag_lines = 0
    for line, times in Counter(lines).items():
        if not line or line.isspace():
            continue
        plain, low, word_groups = seen[line]
        if links and (own := _LINK.findall(line)):
            size = _solid(line)
            line_links += times * size if sum(map(len, own)) * 3 > size else 0
        if tagged:
            tag_lines += times * len(line) if len(_TAG.findall(line)) > 2 else 0
        if _maybe_row(plain) and _ROW.search(plain):
            row += times * _solid(plain)
            continue
        if products and (found := len(_PRODUCT.findall(low))):
            own_words = sum(map(len, word_groups))
            told = own_words >= 5 and _STOP.search(plain.rstrip()[-4:]) and not _ARTICLE.search(plain)  # a sentence with prices
            if found * 7 >= own_words and not told:
                product += times * _solid(plain)
                continue
        for piece, ws in zip(_PIECE.findall(plain) if len(word_groups) > 1 else (plain,), word_groups):
            solid_piece, m = len(piece) - piece.count(" ") if plain_blanks else _solid(piece), len(ws)
            if not solid_piece:
                continue
            ended = piece[-1] in _STOP_SIGNS or _ended(piece)
            if thai and _THAI.search(piece):  # no stops: each blank may end a sentence
                good, ended = solid_piece >= 18 and len(set(ws)) >= 0.7 * m, True
            elif not ended:
                good = False
            elif cjk and _CJK.search(piece):
                good = solid_piece >= 6
            else:
                good = m >= 3 and len(set(ws)) >= 0.55 * m and len("".join(ws)) >= 2.5 * m
            if good and not often:
                sentence += times * solid_piece
                stated += times
                continue
            twice = sum(map(often.__contains__, zip(ws, ws[1:]))) if often and m > 1 else 0
            if ws and (not ended or twice >= 0.4 * m) and sum(map(several.__contains__, ws)) >= 0.7 * m:
                keyword += times * solid_piece
            if good:
                sentence += times * solid_piece
                stated += times
            elif m > 1 and twice >= 0.5 * (m - 1) or m == 1 and counts[ws[0]] > 3:
                repeat += times * solid_piece
    link_chars, tag_chars = sum(map(len, links)), sum(map(len, tags))
    marks = 0 if plain_script else len(_MARK.findall(text))
    return [
        math.log1p(solid), link_chars / solid, tag_chars / solid, tag_lines / max(1, len(text)),
        sentence / solid, repeat / solid, row / solid, product / solid, len(counts) / n, max(counts.values(), default=0) / n, repeated / n, top_triple, keyword / solid,
        sentence / max(1, solid - link_chars - tag_chars), len(links) / (1 + stated), entropy,
        len("".join(words)) / n, len(_STOP.findall(bare)) / n, _separators(bare, plain_blanks) / n, sum(map(text.count, "0123456789")) / solid, len(links) / (n + len(links)),
        line_links / solid, marks / solid,
    ]


def weak_label() -> Column:
    """1.0, 0.0 or null (not clear enough) from the features."""
    c = F.col
    spam = (
        ((c("link_share") > 0.5) & (c("sentence_share") < 0.3) & (c("links_per_sentence") > 1.5))
        | ((c("line_links") > 0.7) & (c("sentence_share") < 0.3) & (c("links_per_sentence") > 1.5))
        | ((c("tag_share") > 0.55) & (c("sentence_share") < 0.35))
        | ((c("product_share") > 0.55) & (c("sentence_share") < 0.3) & (c("row_share") < 0.2))
        | ((c("repeat_share") + c("keyword_share") > 0.9) & (c("sentence_share") < 0.3) & (c("row_share") < 0.05) & (c("digit_share") < 0.1) & (c("distinct_words") < 0.4))
        | ((c("top_triple") > 0.25) & (c("repeated_pairs") > 0.6) & (c("row_share") < 0.1) & (c("distinct_words") < 0.4))
        | ((c("top_triple") > 0.4) & (c("keyword_share") > 0.6) & (c("row_share") < 0.1))
        | ((c("top_triple") > 0.15) & (c("repeated_pairs") > 0.75) & (c("distinct_words") < 0.15) & (c("row_share") < 0.1))
    )
    mixed = c("link_share") + c("tag_share") + c("product_share") + F.greatest(c("repeat_share"), c("keyword_share"))
    spam = spam | ((mixed > 0.7) & (c("sentence_share") < 0.3) & (c("row_share") < 0.1) & (c("digit_share") < 0.2) & ((c("distinct_words") < 0.5) | (c("link_share") + c("tag_share") + c("product_share") > 0.6)))
    clean = (
        ((c("sentence_rest") > 0.75) & (c("links_per_sentence") < 1.1) & (c("tag_share") < 0.3) & ((c("top_triple") < 0.2) | (c("repeated_pairs") < 0.55) & ((c("top_triple") < 0.35) | (c("keyword_share") < 0.3))))
        | ((c("link_share") < 0.05) & (c("tag_share") < 0.05) & (c("product_share") < 0.05) & (c("keyword_share") < 0.2) & (c("repeat_share") < 0.1) & (c("top_triple") < 0.2))
        | ((c("row_share") > 0.5) & (c("link_share") < 0.45) & (c("row_share") > c("link_share")) & (c("product_share") < 0.1) & (c("top_triple") < 0.5))
        | ((c("length") < 2.5) & (c("links_per_word") == 0) & (c("tag_share") == 0))
    )
    return F.when(spam & ~clean, F.lit(1.0)).when(clean & ~spam, F.lit(0.0))


def page_features(df: DataFrame, id_column: str, text_column: str, host_column: str) -> DataFrame:
    """(id, host, FEATURES...) of each text that isn't null or blank."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_parts(batches):
            made = [features(t) for t in batch.column("text").to_pylist()]
            columns = [pa.array([m[i] for m in made], pa.float64()) for i in range(len(FEATURES))]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("host"), *columns], ["id", "host", *FEATURES])

    kind = df.schema[id_column].dataType.simpleString()
    rows = df.select(F.col(id_column).alias("id"), F.coalesce(F.col(host_column).cast("string"), F.lit("")).alias("host"), F.col(text_column).alias("text")).where(r"text rlike '\\S'")
    return rows.mapInArrow(run, f"id {kind}, host string, " + ", ".join(f"{f} double" for f in FEATURES))


def train(labelled: DataFrame) -> RandomForestClassificationModel | None:
    """Bagged trees: bootstrap samples, all features open to every split. None if only one label is there.

    `labelled` has the assembled `features` and a `label`; of each label at most TRAINING_ROWS rows are used.
    """
    rows = [bounded_sample(labelled.where(F.col("label") == v), "id", TRAINING_ROWS) for v in (0.0, 1.0)]
    # in the same order on every run, as the bootstrap samples depend on it
    sample = checkpointed(rows[0].unionByName(rows[1]).select("id", "features", "label").repartition(8, "id").sortWithinPartitions("id").drop("id"))
    counts = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    if len(counts) < 2:
        return None
    # the rarer label weighs as much as the other, up to ten times a row
    weight = F.when(F.col("label") == 1.0, F.lit(min(10.0, max(0.1, counts[0.0] / counts[1.0])))).otherwise(F.lit(1.0))
    sample = sample.withColumn("weight", weight)
    return RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, featureSubsetStrategy="all", bootstrap=True, subsamplingRate=1.0, weightCol="weight", maxMemoryInMB=64, seed=11).fit(sample)


def spam_scores(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", host_column: str = "source") -> DataFrame:
    """(id, page_score, host_rate, score): score above 0.5 is spam.

    host_rate is the mean prediction of the host's pages, drawn towards the mean of all pages where there are
    few of them; a null host is a host of its own. Null and blank texts have no row. Where the weak labels are all
    alike, there is nothing to learn: the page's score is that label, or 0 without any.
    """
    pages = checkpointed(VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(page_features(df, id_column, text_column, host_column)).withColumn("label", weak_label()).select("id", "host", "features", "label"))
    model = train(pages.where("label is not null"))
    if model is None:
        predicted = pages.select("id", "host", F.coalesce("label", F.lit(0.0)).alias("page_score"))
    else:
        predicted = model.transform(pages).select("id", "host", vector_to_array("probability")[1].alias("page_score"))
    predicted = checkpointed(predicted)
    overall = predicted.agg(F.avg("page_score")).first()[0] or 0.0
    hosts = predicted.groupBy("host").agg(((F.sum("page_score") + F.lit(HOST_PRIOR * overall)) / (F.count("*") + HOST_PRIOR)).alias("host_rate"))
    scored = predicted.join(hosts, "host")
    return scored.select(F.col("id").alias(id_column), "page_score", "host_rate", ((1 - HOST_WEIGHT) * F.col("page_score") + HOST_WEIGHT * F.col("host_rate")).alias("score"))
