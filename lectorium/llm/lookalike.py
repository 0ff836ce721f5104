"""One consistent form for texts that look the same: widths, composed accents, blanks, invisible and look-alike characters.

The mapping is compiled once from the Unicode character database and a short table of look-alike letters into a
longest-match transducer over grapheme clusters (a base character with the marks after it), and checked for
conflicts; a text is rewritten in one pass.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectorium.llm.common import checkpointed, in_parts

#: Letters of other scripts that look like Latin ones.
LOOKALIKES = {
    "А": "A", "В": "B", "Е": "E", "Ѕ": "S", "І": "I", "Ј": "J", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "Ү": "Y", "Ԛ": "Q", "Ԝ": "W",
    "а": "a", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "о": "o", "р": "p", "ԛ": "q", "ѕ": "s", "х": "x", "у": "y", "ԝ": "w", "ӏ": "l", "Ӏ": "I",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "ο": "o", "ν": "v", "ϲ": "c", "ϳ": "j",
    "Օ": "O", "օ": "o", "ո": "n", "ս": "u", "հ": "h", "ց": "g", "ɡ": "g", "ɑ": "a", "ı": "ı",
}
_TO_LATIN, _LOOKALIKE = str.maketrans(LOOKALIKES), frozenset(LOOKALIKES)
#: Punctuation that can't be told apart.
SAME_MARKS = {"‐": "-", "‑": "-", "­": "", "․": ".", "ʼ": "’", "∕": "/", "⁄": "/", "∶": ":", "꞉": ":"}
#: Invisible characters that join letters; they are kept where they shape the script.
JOINERS = "‌‍"
#: Ids of one class that are gathered in a list, and the number of classes that may be too large for one part.
LIST, CLASSES = 1_000, 2_000
_KINDS = ("<wide>", "<narrow>", "<noBreak>")


class ConflictError(ValueError):
    """The mapping would not bring a text to one form."""


def _single(c: str) -> str | None:
    """Target of one character by rule; None where it stays."""
    kind = unicodedata.category(c)
    if c in SAME_MARKS:
        return SAME_MARKS[c]
    if kind == "Zs":
        return " "
    if c in JOINERS:
        return None
    if kind == "Cf" and not 0x600 <= ord(c) <= 0x605 and ord(c) not in (0x6DD, 0x70F, 0x8E2) and not 0xE0020 <= ord(c) <= 0xE007F:
        return ""
    if ord(c) in (0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0) or 0xFE00 <= ord(c) <= 0xFE0F or 0xE0100 <= ord(c) <= 0xE01EF:
        return ""
    made = unicodedata.decomposition(c)
    if made.startswith(_KINDS) or made.startswith("<compat>") and 0xFB00 <= ord(c) <= 0xFB17:
        return unicodedata.normalize("NFC", unicodedata.normalize("NFKC", c))
    if made.startswith("<compat>") and 0x2000 <= ord(c) <= 0x200A:
        return " "
    if made and not made.startswith("<"):
        to = unicodedata.normalize("NFC", c)
        return to if to != c else None
    return None


@lru_cache(maxsize=1)
def compiled() -> dict[str, str]:
    """The mapping from character sequences to their form, conflict-checked."""
    table: dict[str, str] = {}

    def put(source: str, target: str) -> None:
        if table.setdefault(source, target) != target:
            raise ConflictError(f"{source!r} to {table[source]!r} and {target!r}")

    for code in range(0x80, sys.maxunicode + 1):
        if 0xD800 <= code <= 0xDFFF or 0xAC00 <= code <= 0xD7A3 or 0xE000 <= code <= 0xF8FF:
            continue
        c = chr(code)
        to = _single(c)
        if to is not None:
            put(c, to)
        parts = unicodedata.normalize("NFD", c)
        if len(parts) > 1 and unicodedata.normalize("NFC", parts) == c:
            put(parts, c)  # decomposed accents
            if len(parts) == 3:
                put(unicodedata.normalize("NFC", parts[:2]) + parts[2], c)
    for code in range(0xFF66, 0xFF9E):  # half-width kana with a sound mark
        for mark, full in (("ﾞ", "゙"), ("ﾟ", "゚")):
            to = unicodedata.normalize("NFC", unicodedata.normalize("NFKC", chr(code)) + full)
            if len(to) == 1:
                put(chr(code) + mark, to)
    for source, target in table.items():
        again = "".join(table.get(c, c) for c in target)
        if again != target:
            raise ConflictError(f"{source!r} gives {target!r}, which is no final form")
    return table


def _to_look(text: str) -> str:
    """`text` with look-alike letters made Latin, those under accents too."""
    parts = unicodedata.normalize("NFD", text)
    return text if _LOOKALIKE.isdisjoint(parts) else unicodedata.normalize("NFC", parts.translate(_TO_LATIN))


@lru_cache(maxsize=1)
def compiled_look() -> dict[str, str]:
    """As `compiled`, with look-alike letters, alone or composed with accents, brought to the Latin ones in the same pass."""
    table = {source: _to_look(target) for source, target in compiled().items()}
    for code in range(0x80, 0x2000):
        c = chr(code)
        to = _to_look(table.get(c, c))
        if to != c and table.setdefault(c, to) != to:
            raise ConflictError(f"{c!r} to {table[c]!r} and {to!r}")
    for source, target in table.items():
        if "".join(table.get(c, c) for c in target) != target:
            raise ConflictError(f"{source!r} gives {target!r}, which is no final form")
    return table


def _unseen() -> list[int]:
    return sorted({ord(s) for s, to in compiled().items() if not to} | {ord(j) for j in JOINERS})


def _spans(codes: list[int]) -> str:
    """Sorted code points as ranges of a character class."""
    spans, start = [], None
    for a, b in zip(codes, [*codes[1:], None]):
        start = a if start is None else start
        if b != a + 1:
            spans.append(f"\\U{start:08x}-\\U{a:08x}")
            start = None
    return "".join(spans)


def _marks() -> list[int]:
    """Characters that may join the one before: marks with a class, second parts of compositions, Hangul vowels and finals."""
    codes = {*range(0x1161, 0x1176), *range(0x11A8, 0x11C3), 0xFF9E, 0xFF9F}
    for code in range(0x300, sys.maxunicode + 1):
        c = chr(code)
        if unicodedata.combining(c):
            codes.add(code)
        parts = unicodedata.decomposition(c)
        if parts and not parts.startswith("<") and " " in parts:
            codes.add(int(parts.split()[1], 16))
    return sorted(c for c in codes if c > 0x7F)


@dataclass(frozen=True)
class _Patterns:
    """The transducer's states as patterns; classes without characters above U+FFFF match much faster."""

    listed: re.Pattern[str]
    joining: re.Pattern[str]
    cluster: re.Pattern[str]


@lru_cache(maxsize=4)
def _patterns(wide: bool, look: bool = False) -> _Patterns:
    def some(codes: list[int]) -> str:
        return _spans([c for c in codes if wide or c <= 0xFFFF])

    marks, unseen, listed = some(_marks()), some(_unseen()), some(sorted(ord(s) for s in (compiled_look() if look else compiled()) if len(s) == 1))
    # a base with the marks after it, joiners, or a listed character; the longest first
    return _Patterns(re.compile(f"[{listed}]"), re.compile(f"[{marks}{unseen}]"), re.compile(f"[^{marks}\\s{unseen}](?:[{unseen}]*[{marks}])+|[{JOINERS}]+|[{listed}]"))


@lru_cache(maxsize=2)
def _singles(look: bool = False) -> dict[int, str]:
    return {ord(s): to for s, to in (compiled_look() if look else compiled()).items() if len(s) == 1}


@lru_cache(maxsize=1)
def _nothing() -> dict[int, None]:
    return dict.fromkeys(_unseen())


def _keeps_joiner(before: str, after: str) -> bool:
    """Whether a joiner shapes what stands around it: after a virama, between Arabic letters, among emoji."""
    return bool(before and after) and (unicodedata.combining(before) == 9 or "؀" <= before <= "ࣿ" and "؀" <= after <= "ࣿ" or ord(before) > 0x1F000)


def canonical(text: str, look: bool = False) -> str:
    """The consistent form of `text`: same look, one spelling. Letters keep their script, unless `look` (see skeleton)."""
    if text.isascii():
        return text
    patterns = _patterns(len(text.encode("utf-16-le", "surrogatepass")) != 2 * len(text), look)
    if not patterns.joining.search(text):  # single characters only
        return text.translate(_singles(look)) if patterns.listed.search(text) else text
    table, unseen = compiled_look() if look else compiled(), _nothing()

    def form(m: re.Match[str]) -> str:
        cluster = m.group()
        to = table.get(cluster)
        if to is None and len(cluster) > 2 and cluster[0] not in JOINERS:  # invisible characters before a mark
            cluster = cluster.translate(unseen)
            to = table.get(cluster)
        if to is not None:
            return to
        if cluster[0] in JOINERS:
            i, j = m.start(), m.end()
            return cluster[0] if _keeps_joiner(text[i - 1] if i else "", text[j] if j < len(text) else "") else ""
        if len(cluster) == 1:
            return cluster
        # the longest listed beginning, then the rest; canonical order of several marks
        cluster = _to_look(unicodedata.normalize("NFC", cluster)) if look else unicodedata.normalize("NFC", cluster)
        out, i = [], 0
        while i < len(cluster):
            for j in (2, 1):
                to = table.get(cluster[i : i + j])
                if to is not None:
                    break
            out.append(cluster[i] if to is None else to)
            i += 1 if to is None else j
        return unicodedata.normalize("NFC", "".join(out))

    return patterns.cluster.sub(form, text)


def skeleton(text: str) -> str:
    """Key that is equal for texts that look the same: the canonical form with look-alike letters made Latin, in one pass."""
    return canonical(text, look=True)


_WORD = re.compile(r"[^\W\d_]+")
_SCRIPTS = (("Latin", re.compile(r"[A-Za-zÀ-ɏ]")), ("Cyrillic", re.compile(r"[Ѐ-ԯ]")), ("Greek", re.compile(r"[Ͱ-Ͽ]")))
_FROM_LATIN = {
    "Cyrillic": str.maketrans({b: a for a, b in reversed(LOOKALIKES.items()) if "Ѐ" <= a <= "ԯ"}),
    "Greek": str.maketrans({b: a for a, b in reversed(LOOKALIKES.items()) if "Ͱ" <= a <= "Ͽ"}),
}


def consistent(text: str) -> str:
    """The canonical form in which each word of mixed scripts is brought to the one script its distinctive letters have."""
    form = canonical(text)
    if form.isascii():
        return form

    def word(m: re.Match[str]) -> str:
        w = m.group()
        plain = w.translate(_TO_LATIN)
        if plain == w and not any(p.search(w) for _, p in _SCRIPTS[1:]):
            return w
        for name, letters in _SCRIPTS[1:]:
            if letters.search(plain):  # a letter that only this script has
                return w.translate(_FROM_LATIN[name])
        return plain if _SCRIPTS[0][1].search(w) else w

    return _WORD.sub(word, form)


def normalised(df: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """(id, form, look): the consistent form of each text and the 128-bit key of its look.

    Null texts have null form and key; empty texts have an empty form. Rows are neither dropped nor joined.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_parts(batches):
            texts = batch.column("text").to_pylist()
            forms = [None if t is None else consistent(t) for t in texts]
            looks = [None if t is None else skeleton(t) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(forms, pa.string()), pa.array(looks, pa.string())], ["id", "form", "look"])

    kind = df.schema[id_column].dataType.simpleString()
    return df.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text")).mapInArrow(run, f"id {kind}, form string, look string").withColumnRenamed("id", id_column)


def same_look_pairs(df: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """(id_a, id_b), id_a < id_b: rows whose texts look the same but aren't equal character by character.

    Equal texts are one class of a look. Classes are paired first, so exact copies form no pairs among themselves
    however many there are; then each class is expanded to its members, those of the smaller one gathered in lists
    of about LIST ids, those of a class above a share of 1 / CLASSES of all rows spread over as many parts as it
    has such shares. Texts are compared by 128-bit digests of text and look, which are shuffled in place of the
    texts. Null and empty texts, null ids and repeated rows give no pair.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_parts(batches):
            looks = [None if t is None else skeleton(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("own"), pa.array(looks, pa.string())], ["id", "own", "look"])

    kind = df.schema[id_column].dataType.simpleString()
    rows = df.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text")).where("id is not null and text <> ''")
    keyed = checkpointed(rows.withColumn("own", F.md5("text")).mapInArrow(run, f"id {kind}, own string, look string").select("id", "own", F.md5("look").alias("look")).distinct())
    classes = checkpointed(keyed.groupBy("look", "own").agg(F.count("*").alias("n")))
    total = classes.agg(F.sum("n")).first()[0] or 0
    share = max(LIST, -(-total // CLASSES))  # a class above it is spread: at most CLASSES of them are broadcast
    large = F.broadcast(classes.where(F.col("n") > share).select("own", F.ceil(F.col("n") / share).cast("int").alias("parts")))
    several = classes.groupBy("look").agg(F.count("*").alias("classes")).where("classes > 1").select("look")
    paired = classes.join(several, "look", "left_semi")
    a, b = paired.alias("a"), paired.alias("b")
    pairs = a.join(b, (F.col("a.look") == F.col("b.look")) & ((F.col("a.n") > F.col("b.n")) | (F.col("a.n") == F.col("b.n")) & (F.col("a.own") > F.col("b.own"))))
    pairs = checkpointed(pairs.select(F.col("a.own").alias("more"), F.col("b.own").alias("fewer"), F.ceil(F.col("b.n") / LIST).alias("slots")))

    def parted(members: DataFrame) -> DataFrame:
        """With the part of its class that each row falls into."""
        return members.join(large, "own", "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64("id"), F.col("parts")), F.lit(0)).cast("int")).drop("parts")

    members = parted(keyed.select("id", "own"))
    asked = pairs.select(F.col("fewer").alias("own"), "slots").distinct()
    lists = members.join(asked, "own").groupBy("own", "part", F.pmod(F.xxhash64("id", F.lit(1)), F.col("slots")).alias("slot")).agg(F.collect_list("id").alias("ids"))  # about LIST ids
    wanted = pairs.join(lists.select(F.col("own").alias("fewer"), "ids"), "fewer").join(large.withColumnRenamed("own", "more"), "more", "left")
    wanted = wanted.select(F.col("more").alias("own"), F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias("part"), "ids")
    made = members.join(wanted, ["own", "part"]).select("id", F.explode("ids").alias("other")).where("id <> other")
    return made.select(F.least("id", "other").alias("id_a"), F.greatest("id", "other").alias("id_b"))
