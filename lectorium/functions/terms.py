"""Terms of texts and queries: words, character trigrams, aliases and control terms."""

from __future__ import annotations

import unicodedata
from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F



def _accents() -> tuple[str, str]:
    """Small Latin letters with an accent, and the letters without it."""
    pairs = [(chr(c), unicodedata.normalize("NFD", chr(c))[0]) for c in range(0xE0, 0x250) if chr(c).islower()]
    pairs = [(c, base) for c, base in pairs if base.isascii() and base != c]
    return "".join(c for c, _ in pairs), "".join(base for _, base in pairs)


ACCENTED, PLAIN = _accents()

#: Terms that stand for several others in lexical search, in their order.
ALIASES: Mapping[str, Sequence[str]] = {
    "文章品質": ("文書", "品質", "読みやすさ", "テクニカルライティング"),
    "ドキュメント運用": ("ドキュメント", "ハンドブック", "運用"),
    "技術文書": ("技術", "文書", "テクニカルライティング"),
    "境界設計": ("境界", "コンテキスト", "境界づけられた"),
    "テナント境界": ("テナント", "境界", "分離"),
    "ドメインモデリング": ("ドメイン", "モデリング", "DDD"),
    "関数型プログラミング": ("関数型", "型", "モデリング"),
}
#: Terms of a query that ask for a comparison, in their order.
CONTROL_TERMS = ("比較したい", "比較", "共通点", "違い", "それぞれ", "対比", "compare", "difference", "both")

#: Runs of one kind: Han, Hiragana, Katakana, or letters, digits and marks of other scripts.
SEGMENT = "\\p{IsHan}+|\\p{IsHiragana}+|[\\p{IsKatakana}ー]+|[\\p{L}\\p{N}\\p{M}&&[^\\p{IsHan}\\p{IsHiragana}\\p{IsKatakana}ー]]+"


def fold(text: Column) -> Column:
    """Small letters without Latin accents; a final sigma is a sigma."""
    return F.translate(F.lower(text), ACCENTED + "ς", PLAIN + "σ")


def words(text: Column) -> Column:
    """Array of the terms of the word index: the folded segments of a text, as questions are cut."""
    return segments(fold(text))


def segments(text: Column) -> Column:
    """Array of surfaces: runs of one script, so that words of unspaced text are found. The place of a morphological analyser."""
    return F.regexp_extract_all(text, F.lit(SEGMENT), F.lit(0))


def query_segments(text: Column) -> Column:
    """Folded segments of a query, any of which may match; those of one character are left out.

    If none is left, the query's own words stand in.
    """
    found = F.filter(words(text), lambda t: F.length(t) > 1)
    return F.when(F.size(found) > 0, found).otherwise(words(text))


def trigrams(text: Column) -> Column:
    """Array of all windows of three characters, small letters, accents kept."""
    return F.regexp_extract_all(F.lower(text), F.lit("(?s)(?=(...))"), F.lit(1))


def trigram_terms(query: Column) -> Column:
    """Terms of a query for the trigram index, all of which must match; those under three characters are left out."""
    return F.filter(F.split(F.lower(F.trim(query)), "\\s+"), lambda t: F.length(t) >= 3)


def occurrences(text: Column, term: Column) -> Column:
    """How often `term` occurs in `text`, overlaps included; both in small letters already."""
    pattern = F.concat(F.lit("(?=(\\Q"), F.replace(term, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E))"))
    return F.size(F.regexp_extract_all(text, pattern, F.lit(1)))


def expand_query(query: Column) -> Column:
    """`query` with the synonyms of the aliases it contains, each once and only if not in it already."""
    low = F.lower(query)
    made = F.array().cast("array<string>")
    for key, synonyms in ALIASES.items():
        made = F.concat(made, F.when(low.contains(key.lower()), F.array(*map(F.lit, synonyms))).otherwise(F.array().cast("array<string>")))
    # aliases differ in more than their case, so equal means equal
    extra = F.filter(F.array_distinct(made), lambda s: ~F.contains(low, F.lower(s)))
    return F.when(F.size(extra) > 0, F.concat_ws(" ", query, F.array_join(extra, " "))).otherwise(query)


def control_terms(query: Column) -> Column:
    """The control terms that `query` contains, in their order."""
    return F.filter(F.array(*map(F.lit, CONTROL_TERMS)), lambda t: F.contains(F.lower(query), t))


def is_comparison(query: Column) -> Column:
    return F.size(control_terms(query)) > 0


def is_plain_query(query: Column) -> Column:
    """Whether a query has no sign or bare operator that a strict full-text grammar would take for its own."""
    signs = query.rlike("[\\x00-\\x7f&&[^A-Za-z0-9_\\s]]")
    operators = query.rlike("(?:^|\\s)(?:AND|OR|NOT|NEAR)(?:\\s|$)")
    return ~signs & ~operators
