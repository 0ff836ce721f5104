"""Text as Column expressions: cleaning, paragraphs, quality measures, byte-safe cuts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lectorium.schema import CORRUPT_RATIO, CORRUPT_RUN, CORRUPT_SAMPLE

#: Decorative symbols that layouts put before headings and list items.
DECORATIVE = "■□●○◆◇▲△▼▽★☆※◎▪▫►▻◄◅"
#: Characters that hint at damage: control, format, private use, surrogates, and the replacement character. The
#: separators U+001C to U+001F and U+0085 count as blanks.
SUSPICIOUS = "[[\\p{Cc}\\p{Cf}\\p{Co}\\p{Cs}\\x{FFFD}]&&[^\\s\\x{1C}-\\x{1F}\\x{85}]]"
BLANK = "[\\s\\x{1C}-\\x{1F}\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]"
NON_BLANK = BLANK.replace("[", "[^", 1)


def strip(text: Column) -> Column:
    """Without blanks of any script at either end."""
    return F.regexp_replace(text, f"^{BLANK}+|{BLANK}+$", "")


def clean_text(text: Column) -> Column:
    """Layout artefacts removed: decorative symbols, lines of one character, blank lines, runs of empty lines, indents."""
    text = F.translate(text, DECORATIVE, "")
    text = F.regexp_replace(text, "(?d)(.)\n(?=.\n|.$)", "$1")
    text = F.regexp_replace(text, f"(?m)(?d)^{BLANK}+$", "")
    text = F.regexp_replace(text, "\n{3,}", "\n\n")
    lines = F.transform(F.split(text, "\n"), strip)
    return strip(F.array_join(lines, "\n"))


def split_paragraphs(text: Column) -> Column:
    """Array of the stripped, non-empty parts between two or more line breaks."""
    return F.filter(F.transform(F.split(text, "\n{2,}"), strip), lambda p: p != "")


def printable_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(NON_BLANK)).cast("bigint")


def suspicious_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(SUSPICIOUS)).cast("bigint")


def suspicious_ratio(text: Column) -> Column:
    """Share of the characters other than blanks that are suspicious; 0 for none."""
    printable = printable_count(text)
    return F.when(printable > 0, suspicious_count(text) / printable).otherwise(F.lit(0.0))


def looks_corrupt(text: Column) -> Column:
    """Whether the first characters hold a run of suspicious ones or a high share of them; blank texts don't."""
    head = F.substring(text, 1, CORRUPT_SAMPLE)
    run = head.rlike(f"{SUSPICIOUS}{{{CORRUPT_RUN}}}")
    return F.coalesce((printable_count(head) > 0) & (run | (suspicious_ratio(head) >= CORRUPT_RATIO)), F.lit(False))


def non_blank_length(text: Column) -> Column:
    return F.length(F.regexp_replace(text, f"{BLANK}+", ""))


def cut_bytes(text: Column, limit: Column | int) -> Column:
    """At most `limit` bytes of UTF-8, never part of a character."""
    limit = F.lit(limit) if isinstance(limit, int) else limit
    raw = F.encode(text, "UTF-8")
    head = F.hex(raw.substr(F.lit(1), limit))
    # drop an incomplete last character: a lead byte with fewer continuation bytes than it announces
    whole = F.regexp_replace(head, "(?:[CD][0-9A-F]|E[0-9A-F](?:[89AB][0-9A-F])?|F[0-7](?:[89AB][0-9A-F]){0,2})$", "")
    aligned = F.when(F.length(head) % 2 == 0, whole)
    return F.when(F.octet_length(text) <= limit, text).otherwise(F.decode(F.unhex(aligned), "UTF-8"))


def clipped(text: Column, limit: Column | int, mark: str = "...") -> Column:
    """`text` cut to `limit` bytes with a mark where something was cut; a limit of 0 or less cuts nothing."""
    bound = F.lit(limit) if isinstance(limit, int) else limit
    return F.when((bound > 0) & (F.octet_length(text) > bound), F.concat(cut_bytes(text, bound), F.lit(mark))).otherwise(text)


def file_stem(path: Column) -> Column:
    """Name of a file without its folders and its last extension."""
    return F.regexp_replace(F.regexp_extract(path, "([^/]*)$", 1), "(?<=.)\\.[^.]*$", "")


def detect_format(path: Column) -> Column:
    """pdf, epub or '' from the extension, in any case."""
    extension = F.lower(F.regexp_extract(path, "\\.([^./]*)$", 1))
    return F.when(extension.isin("pdf", "epub"), extension).otherwise(F.lit(""))


def title_or_stem(title: Column, path: Column, book_format: Column) -> Column:
    """A book's title: its metadata unless empty or, for EPUB, a placeholder; else its file's stem."""
    plain = F.lower(strip(title))
    placeholder = (plain == "") | plain.isin("unknown", "untitled") | F.lower(title).contains("(blank)")
    missing = title.isNull() | (title == "") | ((book_format == "epub") & placeholder)
    return F.when(missing, file_stem(path)).otherwise(title)
