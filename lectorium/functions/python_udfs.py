"""What built-in functions can't say: compatibility forms, repair of damaged text, HTML. All in Arrow batches."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectorium.functions.text import DECORATIVE

_ODD = ("Cc", "Cf", "Co", "Cs")


def compatibility_form(text: str | None) -> str | None:
    return None if text is None else unicodedata.normalize("NFKC", text)


def title_key(text: str | None) -> str | None:
    """Title for comparison: compatibility form, stripped, in small letters."""
    return None if text is None else unicodedata.normalize("NFKC", text).strip().lower()


# The patterns of layout artefacts.
_DECORATIVE = re.compile(f"[{DECORATIVE}]")
_SINGLES = re.compile(r"(.)\n(?=.\n|.$)")
_BLANK_LINES = re.compile(r"^\s+$", re.MULTILINE)


def cleaned(text: str) -> str:
    """As functions.text.clean_text, for use within a repair."""
    text = _SINGLES.sub(r"\1", _DECORATIVE.sub("", text))
    text = re.sub(r"\n{3,}", "\n\n", _BLANK_LINES.sub("", text))
    return "\n".join(line.strip() for line in text.split("\n")).strip()


def _damage(text: str) -> tuple[float, int, int]:
    seen = [c for c in text if not c.isspace()]
    odd = sum(c == "�" or unicodedata.category(c) in _ODD for c in seen)
    return (odd / len(seen) if seen else 0.0), len(seen), odd


def repaired(text: str | None) -> tuple[str | None, bool]:
    """(text without damaged characters, True) if that lowers their share and loses nothing else; else (text, False)."""
    if not text:
        return text, False
    made = unicodedata.normalize("NFKC", text).replace("\r\n", "\n").replace("\r", "\n").replace("�", "")
    made = cleaned("".join(c for c in made if c in "\n\t" or unicodedata.category(c) not in _ODD))
    share, seen, odd = _damage(text)
    new_share, new_seen, _ = _damage(made)
    if made == text or new_share >= share or (seen and not new_seen) or new_seen < seen - odd:
        return text, False
    return made, True


class _Text(HTMLParser):
    """Collects text nodes; scripts, styles and comments are left out."""

    HIDDEN = ("script", "style", "template")

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.open: list[str] = []

    def _flush(self) -> None:
        text = "".join(self.open).strip()
        self.open = []
        if text:
            self.parts.append(text)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self._flush()
        self.hidden = tag if tag in self.HIDDEN else getattr(self, "hidden", None)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self._flush()

    def handle_endtag(self, tag: str) -> None:
        self._flush()
        if getattr(self, "hidden", None) == tag:
            self.hidden = None

    def handle_data(self, data: str) -> None:
        if not getattr(self, "hidden", None):
            self.open.append(data)

    def handle_comment(self, data: str) -> None:
        self._flush()


def html_text(html: str | None) -> str | None:
    """Text nodes of a document, each stripped, one a line."""
    if html is None:
        return None
    parser = _Text()
    parser.feed(html)
    parser.close()
    parser._flush()
    return "\n".join(parser.parts)


@F.pandas_udf(T.StringType())
def nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(compatibility_form, na_action="ignore")


@F.pandas_udf(T.StringType())
def normalize_title(texts: pd.Series) -> pd.Series:
    return texts.map(title_key, na_action="ignore")


@F.pandas_udf(T.StringType())
def html_to_text(texts: pd.Series) -> pd.Series:
    return texts.map(html_text, na_action="ignore")


@F.pandas_udf(T.StructType([T.StructField("text", T.StringType()), T.StructField("changed", T.BooleanType())]))
def repair_text(texts: pd.Series) -> pd.DataFrame:
    rows = [repaired(None if t is None or t is pd.NA else t) for t in texts.astype(object).where(texts.notna(), None)]
    return pd.DataFrame(rows, columns=["text", "changed"])


@F.udtf(returnType=T.StructType([T.StructField("chunk_order", T.IntegerType()), T.StructField("body", T.StringType()), T.StructField("char_count", T.IntegerType())]))
class ChunkText:
    """chunk_text(text, size, overlap): the chunks of one text, for use in SQL with LATERAL.

    The native form is operators.chunking.chunk_texts; this one gives the same rows.
    """

    def eval(self, text: str, size: int, overlap: int):
        if text is None:
            return
        paragraphs = (p.strip() for p in re.split(r"\n{2,}", text))
        pieces = [x for p in paragraphs if p for x in (_cut(p, size) if len(p) > 2 * size else [p])]
        tail = ""
        for i, group in enumerate(_grouped(pieces, size)):
            body = "\n\n".join(([tail] if tail else []) + group)
            tail = body[-overlap:] if overlap > 0 else ""
            yield i, body, len(body)


def _grouped(pieces: Iterable[str], size: int) -> list[list[str]]:
    """Neighbouring pieces in groups of at most `size` characters; a larger piece is a group of its own."""
    groups: list[list[str]] = []
    room = -1
    for piece in pieces:
        if len(piece) > room:
            groups.append([])
            room = size
        groups[-1].append(piece)
        room -= len(piece)
    return groups


def _cut(paragraph: str, size: int) -> list[str]:
    """A long paragraph cut after Japanese sentence ends and line breaks."""
    groups = _grouped(re.findall(r"[^。？！\n]*[。？！\n]|[^。？！\n]+$", paragraph), size)
    made = ["".join(g).strip() for g in groups]
    return (made if made[-1] else made[:-1]) or [paragraph]


def register(spark: SparkSession) -> None:
    """Makes the functions callable from SQL under their own names."""
    spark.udtf.register("chunk_text", ChunkText)
    for name, function in (("nfkc", nfkc), ("normalize_title", normalize_title), ("html_to_text", html_to_text), ("repair_text", repair_text)):
        spark.udf.register(name, function)
