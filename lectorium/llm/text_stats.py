"""Statistics of texts and a verdict whether they are prose.

A text is a fold of line states. Texts above SEGMENT characters are cut anywhere; each part gives a state (totals
of its complete lines, and its open first and last line), and states of neighbouring parts are merged, which
corrects what the cut fell into: a word, a line, or both. The merge is associative, so parts are merged in
groups of FAN_IN, level by level.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectorium.llm.common import in_parts

SEGMENT = 32_768
FAN_IN = 32
#: Characters kept of an open line's ends; longer words at a cut are never common words.
EDGE = 48

#: Frequent function words, by language, in natural order.
COMMON_WORDS = {
    "en": "the a an of and or to in on is was are be by for with that this which who what when we it not as at from has have been every each another our now but",
    "de": "der die das den dem des und ist in auf mit nach von zu für nicht wenn ein eine im vor seit über",
    "fr": "le la les de des du et est dans à un une sur mais que qui pour pas dès là où en",
    "es": "el la los las de del y en que un una con por según también desde sin se no",
    "pt": "o a os as de do da em um uma com que por não mas na no já se",
    "it": "il lo la i gli le di del e in un una con che per non",
    "ru": "и в на с по не к а но однако что как после до из без за от для",
    "el": "ο η το τον την τη και σε με για από που του της τις",
    "hi": "का की के को में है और से पर यह वह हैं",
    "ar": "في من على إلى إن أن و كل بعد مع هذا ما دون",
}
COMMON = frozenset(w for words in COMMON_WORDS.values() for w in words.split())
#: Common words that stand in plain names of things as well.
IN_NAMES = frozenset("of de des du del do da di von la le el".split())

#: Letters, digits and the marks of letters, in texts whose underscores are blanks.
_WORD = re.compile("[\\w\u0300-\u036f\u064b-\u065f\u0900-\u0963\u0970-\u0dff\u0e31-\u0e4e]+")
_STOPS = re.compile(r"[.!?…。！？।؟;:]")
_UNSPACED = re.compile("[぀-ヿ㐀-鿿가-힣ｦ-ﾟ]")
_THAI = re.compile("[฀-๿]")
_ODD = re.compile(r"[!-/:-@\[-`{-~─-◿§<>|]")
_DIGIT = re.compile("[0-9]")
_AFTER_STOP = " \t\r\v\f\"'”’»›)]」』\u00a0\u3000"
_STOP_CHARS = frozenset(".!?…。！？।؟;:")


def _ends(tail: str) -> bool:
    """Whether a line ends in punctuation, closing quotes and brackets aside."""
    return tail.rstrip(_AFTER_STOP)[-1:] in _STOP_CHARS and bool(tail.rstrip(_AFTER_STOP))


# places in a line's vector
CHARS, SOLID, WORDS, WORD_CHARS, COMMONS, STOPS, ODD, DIGITS, UNSPACED, THAI, CELLS, COMMAS, PAIRS, NAMES = range(14)
WIDTH = 14

_CELL = re.compile(r"\t|\||;(?=\S)|(?<=\S),(?=\S)| {2,}(?=\S)| [·•/] ")
_PAIR = re.compile(r"\w=|→|=>|->")


def line_vector(s: str, lower: str) -> list[int]:
    """Additive counts of (a part of) a line."""
    words = _WORD.findall(lower.replace("_", " ") if "_" in lower else lower)
    known = [w for w in words if w in COMMON]
    plain = s.isascii()
    return [
        len(s), len(s) - s.count(" ") - s.count("\t"), len(words), sum(map(len, words)), len(known), len(_STOPS.findall(s)), len(_ODD.findall(s)),
        len(_DIGIT.findall(s)), 0 if plain else len(_UNSPACED.findall(s)), 0 if plain else len(_THAI.findall(s)), len(_CELL.findall(s)),
        s.count(", ") + s.count("、") + s.count("،"), len(_PAIR.findall(s)), sum(w in IN_NAMES for w in known),
    ]


# a line: (vector, first EDGE characters, last EDGE characters)
Line = tuple[list[int], str, str]


def part_of_line(s: str) -> Line:
    return line_vector(s, s.lower()), s[:EDGE], s[-EDGE:]


def _ending_word(s: str) -> str:
    i = len(s)
    while i and s[i - 1] != "_" and _WORD.match(s[i - 1]):
        i -= 1
    return s[i:]


def _starting_word(s: str) -> str:
    i = 0
    while i < len(s) and s[i] != "_" and _WORD.match(s[i]):
        i += 1
    return s[:i]


def join_lines(a: Line, b: Line) -> Line:
    """The line that parts `a` and `b` make up."""
    if not a[1]:
        return b
    if not b[1]:
        return a
    v = [x + y for x, y in zip(a[0], b[0])]
    left, right = _ending_word(a[2]), _starting_word(b[1])
    if left and right:  # the cut fell into a word
        whole = (left + right).lower()
        v[WORDS] -= 1
        for place, words in ((COMMONS, COMMON), (NAMES, IN_NAMES)):
            v[place] += (whole in words and len(whole) < EDGE) - (left.lower() in words) - (right.lower() in words)
    around = a[2][-3:] + b[1][:3]  # what the patterns of separators find across the cut but not in the parts
    cut = len(a[2][-3:])
    for place, pattern in ((CELLS, _CELL), (PAIRS, _PAIR)):
        v[place] += len(pattern.findall(around)) - len(pattern.findall(around[:cut])) - len(pattern.findall(around[cut:]))
    v[COMMAS] += around[cut - 1 : cut + 1] == ", "
    return v, (a[1] + b[1])[:EDGE], (a[2] + b[2])[-EDGE:]


_BULLET = re.compile(r"\s*(?:[-*•·▪◦‣●■]\s|\[[ xX]\]|\(?\d{1,3}(?:\.\d{1,3})*[.):]?\s|\(?[a-zA-Zа-я][).]\s|#)")
_LEADER = re.compile(r"\.{4,}|(?:\. ){3,}|…{2,}(?=\s*\d)|…{4,}|_{4,}|-{4,}|·{3,}")
_NUMBER_END = re.compile(r"(?:[\s.…,(·_-]|^)[\divxlIVXL]+\)?\s*$")
_LOG = re.compile(r"\s*(?:\[?\d{4}[-/.]\d{2}[-/.]\d{2}|\d{1,2}:\d{2}(?::\d{2})|\d{4,}\s|(?:DEBUG|INFO|WARN|WARNING|ERR|ERROR|FATAL|TRACE|GET|PUT|POST|HEAD|DELETE)\b|\d{1,3}(?:\.\d{1,3}){3})")
_KEY = re.compile(r"\s*[\w.\[\] •*-]{1,48}?\s?[:=：]\s?\S")
_HEX = re.compile(r"(?:[0-9a-fA-F]{2}\s){6,}")

STRUCTURED, SHORT_ITEM, SHORT_PLAIN, PROSE, BLANK = range(5)


def line_kind(line: Line) -> int:
    """What a complete line is: structured (row, entry, log, rubbish), a short one that may be an item, or prose."""
    v, head, tail = line
    solid, words = v[SOLID], v[WORDS]
    if not solid or not head.strip() and not tail.strip() and not words and not v[ODD]:
        return BLANK
    tail = tail.rstrip()
    ended = _ends(tail)
    spaced = v[UNSPACED] * 3 < solid and v[THAI] * 3 < solid
    size = words if spaced else solid / (3 if v[THAI] * 3 < solid else 6)
    # running text, of which none of what follows holds
    if words > 8 and v[COMMONS] - v[NAMES] > 0.25 * words and not v[CELLS] and not v[PAIRS] and v[ODD] + v[DIGITS] < 0.12 * solid:
        return PROSE
    # rubbish: mostly signs and digits, or unbroken runs of letters and digits
    if v[ODD] + v[DIGITS] > 0.5 * solid:
        return STRUCTURED
    if _HEX.match(head) and v[DIGITS] > 0.15 * solid and v[WORD_CHARS] < 2.3 * words:
        return STRUCTURED
    if spaced and v[CHARS] >= 30 and words and v[WORD_CHARS] / words > 14 and (v[DIGITS] > 0.04 * solid or v[CHARS] > 60 * max(1, v[CHARS] - solid)) and head.isascii():
        return STRUCTURED
    if v[CHARS] == solid >= 20 and head.isascii() and v[DIGITS] and not ended and "://" not in head and head.lower() != head:
        return STRUCTURED
    if (v[ODD] > 3 or "…" in head or "…" in tail or "·" in head) and (_LEADER.search(head) or _LEADER.search(tail)):
        return STRUCTURED
    if _LOG.match(head) and (v[PAIRS] or v[DIGITS] > 0.15 * solid):
        return STRUCTURED
    if v[PAIRS] and size <= 14 * v[PAIRS] and not (ended and size > 8):
        return STRUCTURED
    commons = v[COMMONS] - v[NAMES]
    if v[CELLS] >= 2 and size <= 5 * (v[CELLS] + 1) and commons <= 0.15 * words and not (v[STOPS] and ended and size > 6):
        return STRUCTURED
    if v[CELLS] >= 1 and ("\t" in head or "   " in head.strip()) and size <= 12 and not ended:
        return STRUCTURED
    if v[COMMAS] >= 2 and commons <= 0.08 * words and (not ended or tail[-1:] in ";:") and not v[STOPS] and size <= 4.5 * (v[COMMAS] + 1):
        return STRUCTURED
    if _NUMBER_END.search(tail) and size <= 12 and not v[STOPS] and commons <= 0.25 * words and (v[COMMAS] or _BULLET.match(head) or tail.endswith(")")):
        return STRUCTURED
    if _BULLET.match(head) and size <= 9 and not ended and (size <= 6 or commons <= 0.25 * words):
        return STRUCTURED
    if _KEY.match(head) and not ended and size <= 9 and commons <= 0.2 * words:
        return STRUCTURED
    if ended or size > 8:
        return PROSE
    first = next((c for c in head if c.isalnum()), "")
    if spaced:
        item = words <= 2 or words <= 5 and not commons and not v[STOPS] and (first.islower() or head.isupper() or not first.isupper())
    else:
        item = size <= (2.4 if v[THAI] * 3 < solid else 2.8) and not v[STOPS]
    return SHORT_ITEM if item else SHORT_PLAIN


# totals of complete lines: counts, then characters and numbers of lines by kind, and lines that end in punctuation
LINES, ENDED = WIDTH, WIDTH + 1
KIND_CHARS, KIND_LINES = WIDTH + 2, WIDTH + 7
SHORT_STOPS, SHORT_WORDS, SHORT_COMMONS = WIDTH + 12, WIDTH + 13, WIDTH + 14
TOTALS = WIDTH + 15


def add_line(totals: list[int], line: Line) -> None:
    v = line[0]
    for i in range(WIDTH):
        totals[i] += v[i]
    kind = line_kind(line)
    totals[KIND_CHARS + kind] += v[SOLID]
    totals[KIND_LINES + kind] += 1
    if kind != BLANK:
        totals[LINES] += 1
        totals[ENDED] += _ends(line[2])
    if kind in (SHORT_ITEM, SHORT_PLAIN) or kind == PROSE and v[SOLID] < 40:
        totals[SHORT_STOPS] += v[STOPS]
        totals[SHORT_WORDS] += v[WORDS]
        totals[SHORT_COMMONS] += v[COMMONS] - v[NAMES]


# a state: None for no text; (line,) within one line; (first line, totals, last line)
State = tuple | None


def state_of(text: str) -> State:
    """State of a part of a text."""
    if not text:
        return None
    lines = text.split("\n")
    if len(lines) == 1:
        return (part_of_line(text),)
    totals = [0] * TOTALS
    for s in lines[1:-1]:
        add_line(totals, part_of_line(s))
    return part_of_line(lines[0]), totals, part_of_line(lines[-1])


def merge(a: State, b: State) -> State:
    """State of two neighbouring parts; associative, with None as its neutral element."""
    if a is None or b is None:
        return a if b is None else b
    if len(a) == 1 and len(b) == 1:
        return (join_lines(a[0], b[0]),)
    if len(a) == 1:
        return join_lines(a[0], b[0]), b[1], b[2]
    if len(b) == 1:
        return a[0], a[1], join_lines(a[2], b[0])
    totals = [x + y for x, y in zip(a[1], b[1])]
    add_line(totals, join_lines(a[2], b[0]))
    return a[0], totals, b[2]


def totals_of(state: State) -> list[int]:
    """Totals of a whole text, its first and last line closed."""
    totals = [0] * TOTALS
    if state is not None:
        if len(state) == 3:
            totals = list(state[1])
        add_line(totals, state[0])
        if len(state) == 3:
            add_line(totals, state[2])
    return totals


def verdict(t: list[int]) -> tuple[float, bool | None]:
    """(share of characters that belong to structured lines, whether the text is prose; None for blank texts).

    Short lines without structure are a list's items if at least half of them look like names of things, hardly a
    sentence ends in them and few of their words are common ones; else they are prose that was broken into lines.
    """
    solid = sum(t[KIND_CHARS : KIND_CHARS + 5])
    if not solid:
        return 0.0, None
    items, plain = t[KIND_LINES + SHORT_ITEM], t[KIND_LINES + SHORT_PLAIN]
    short = t[KIND_CHARS + SHORT_ITEM] + t[KIND_CHARS + SHORT_PLAIN]
    spoken = t[SHORT_STOPS] > 0.12 * (items + plain) or t[SHORT_COMMONS] > 0.1 * t[SHORT_WORDS]
    listed = items >= plain and not spoken and (items + plain >= 3 or t[KIND_LINES + STRUCTURED])
    share = (t[KIND_CHARS + STRUCTURED] + (short if listed else 0)) / solid
    return share, share <= 0.5


COLUMNS = "n_chars bigint, n_lines bigint, n_words bigint, mean_word_length double, symbol_ratio double, ended_line_share double, common_word_share double, structured_share double, is_prose boolean"


def figures(t: list[int]) -> tuple:
    lines, words, solid = t[LINES], t[WORDS], t[SOLID]
    share, prose = verdict(t)
    return (t[CHARS], lines, words, t[WORD_CHARS] / words if words else None, t[ODD] / solid if solid else None, t[ENDED] / lines if lines else None, t[COMMONS] / words if words else None, share if solid else None, prose)


def text_statistics(df: DataFrame, keys: list[str], text_column: str) -> DataFrame:
    """`keys` and the statistics of each text (COLUMNS); n_chars leaves line breaks out.

    Null texts have null everywhere, blank ones 0 counts and null ratios and verdict. Each row gives one row;
    repeated rows repeat it, but rows above SEGMENT characters with equal keys are taken for one. Words are runs of letters
    and digits; in scripts without blanks a run is one word. Other columns of `df` are ignored.
    """
    rows = df.select(*keys, F.col(text_column).cast("string").alias("_text"))
    kinds = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    fields = [c.split()[0] for c in COLUMNS.split(", ")]
    arrow = dict(bigint=pa.int64(), double=pa.float64(), boolean=pa.bool_())
    types = [arrow[c.split()[1]] for c in COLUMNS.split(", ")]

    def finished(batch: pa.RecordBatch, states: list) -> pa.RecordBatch:
        values = [(None,) * len(fields) if s is False else figures(totals_of(s)) for s in states]
        made = [pa.array([v[i] for v in values], kind) for i, kind in enumerate(types)]
        return pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), *made], [*keys, *fields])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_parts(batches):
            yield finished(batch, [False if t is None else state_of(t) for t in batch.column("_text").to_pylist()])

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_parts(batches):
            states = [pickle.dumps(state_of(t)) for t in batch.column("_text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), batch.column("_at"), pa.array(states, pa.binary())], [*keys, "_at", "_state"])

    def folded(parts: list[dict]) -> State:
        state = None
        for _, x in sorted({x["_at"]: x["_state"] for x in parts}.items()):  # a re-delivered row gives each part again
            state = merge(state, pickle.loads(x))
        return state

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_parts(batches):
            states = [pickle.dumps(folded(p)) for p in batch.column("_parts").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), batch.column("_at"), pa.array(states, pa.binary())], [*keys, "_at", "_state"])

    def closed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_parts(batches):
            yield finished(batch, [folded(p) for p in batch.column("_parts").to_pylist()])

    short = rows.where(F.col("_text").isNull() | (F.length("_text") <= SEGMENT)).mapInArrow(whole, f"{kinds}, {COLUMNS}")
    # texts longer than a segment: two levels of merging hold texts of SEGMENT x FAN_IN characters in a group of the last
    parts = rows.where(F.length("_text") > SEGMENT).select(*keys, F.posexplode(F.expr(f"transform(sequence(0, (length(_text) - 1) div {SEGMENT}), i -> substring(_text, i * {SEGMENT} + 1, {SEGMENT}))")).alias("_at", "_text"))
    states = parts.repartition(*(F.col(k) for k in keys), (F.col("_at") / FAN_IN).cast("bigint")).mapInArrow(part, f"{kinds}, _at int, _state binary")
    parts_of = F.collect_list(F.struct("_at", "_state")).alias("_parts")
    states = states.groupBy(*keys, (F.col("_at") / FAN_IN).cast("int").alias("_group")).agg(parts_of).withColumnRenamed("_group", "_at").mapInArrow(merged, f"{kinds}, _at int, _state binary")
    long = states.groupBy(*keys).agg(parts_of).mapInArrow(closed, f"{kinds}, {COLUMNS}")
    return short.unionByName(long)
