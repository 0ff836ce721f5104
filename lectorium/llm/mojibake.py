"""Texts that were decoded with a wrong character encoding: finding them and restoring them.

A multinomial classifier on hashed byte bigrams names the exact chain (true encoding, wrong encoding) of a token.
It is trained on a bounded sample of the corpus, garbled by every chain. The chain is inverted, and a token counts
as garbled only if its bytes decode strictly under the true encoding (at a replacement character the sequence cut
there may be incomplete) and the result is likelier as clean text than what stood there; tokens that lost bytes
need much evidence. Western encodings taken for each other are judged by words too: those of all texts, which
the restored forms of suspect tokens are joined with.
"""

from __future__ import annotations

import codecs
import re
from collections.abc import Collection, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectorium.llm.common import bounded_sample, checkpointed, in_parts

#: Rows of the training sample: a documented bound; rows are chosen by their hashes.
SAMPLE_ROWS = 3_000
#: Of longer texts a piece of this length enters the sample, which the driver holds.
SAMPLE_CHARACTERS = 20_000
#: Rows of the sample garbled by each chain.
ROWS_PER_CHAIN = 400
BUCKETS = 1 << 14

#: The wrong and the true encodings of the chains.
WRONG = ("cp1252", "latin-1", "cp1250", "cp1251", "mac_roman", "cp437", "cp850", "cp866", "koi8-r", "cp932", "gbk")
TRUE_MULTI = ("utf-8", "cp932", "euc_jp", "gbk", "big5", "euc_kr")
TRUE_SINGLE = ("cp1251", "koi8-r", "cp866", "cp1253", "cp874", "cp1255", "cp1256")
#: Wrong encodings under which bytes get lost, as not every sequence is defined there.
LOSING = ("cp1252", "cp1250", "cp932", "gbk")
#: Chains of two steps: text garbled twice.
TWICE = (("utf-8", "cp1252"), ("utf-8", "latin-1"))

#: Western encodings taken for each other: a character or two of a word are wrong, so whole lines are judged.
WESTERN = (("cp1252", "cp850"), ("cp1252", "cp437"), ("cp1252", "mac_roman"), ("mac_roman", "cp1252"), ("cp850", "cp1252"), ("cp437", "cp1252"))
#: Gain in log probability that a line, and a page, must show for that.
LINE_GAIN, PAGE_GAIN = 10.0, 16.0

#: Words that a task keeps in mind so as to send each of them once.
WORDS_IN_MIND = 200_000

Chain = tuple[tuple[str, str], ...]


def chains() -> list[Chain]:
    single = [((right, wrong),) for right in (*TRUE_MULTI, *TRUE_SINGLE) for wrong in WRONG if right != wrong and not (right in TRUE_SINGLE and wrong in ("cp932", "gbk"))]
    return [*single, *(tuple([step] * 2) for step in TWICE)]


@lru_cache(maxsize=None)
def _byte_chars(codec: str) -> tuple[str, object] | None:
    """For a single-byte codec, its 256 characters, undefined bytes standing for themselves, and the map back."""
    if codec in ("utf-8", "cp932", "euc_jp", "gbk", "big5", "euc_kr"):
        return None
    chars = []
    for b in range(256):
        try:
            chars.append(bytes([b]).decode(codec))
        except UnicodeDecodeError:
            chars.append(chr(b))
    return "".join(chars), codecs.charmap_build("".join(chars))


def decode_loosely(raw: bytes, codec: str) -> str:
    """How a careless program reads `raw`: undefined bytes pass, broken sequences become replacement characters."""
    known = _byte_chars(codec)
    return codecs.charmap_decode(raw, "strict", known[0])[0] if known else raw.decode(codec, "replace")


def encode_exactly(text: str, codec: str) -> bytes | None:
    """The bytes that were read as `text`; None if there are none."""
    known = _byte_chars(codec)
    try:
        return codecs.charmap_encode(text, "strict", known[1])[0] if known else text.encode(codec)
    except UnicodeEncodeError:
        return None


def garble(text: str, chain: Chain) -> str | None:
    """`text` as the chain garbles it; None where an encoding lacks a character."""
    for right, wrong in chain:
        raw = encode_exactly(text, right)
        if raw is None:
            return None
        text = decode_loosely(raw, wrong)
    return text


def _whole_sequences(raw: bytes, cut_left: bool, cut_right: bool) -> bytes:
    """UTF-8 without the sequences that a lost byte left incomplete at either end."""
    if cut_left:
        raw = raw.lstrip(bytes(range(0x80, 0xC0)))
    if cut_right:
        for back in range(1, min(4, len(raw)) + 1):
            lead = raw[-back]
            if lead >= 0xC0:
                if back < (2 if lead < 0xE0 else 3 if lead < 0xF0 else 4):
                    raw = raw[:-back]
                break
            if lead < 0x80:
                break
    return raw


_LOST = re.compile("�+")


def restore(text: str, chain: Chain) -> tuple[str, bool] | None:
    """(restored text, whether nothing was lost); None unless what is there decodes strictly along the chain."""
    whole = True
    for right, wrong in reversed(chain):
        pieces, last = [], 0
        spans = [*(m.span() for m in _LOST.finditer(text)), (len(text), len(text))]
        for start, end in spans:
            piece = text[last:start]
            if piece:
                raw = encode_exactly(piece, wrong)
                if raw is None:
                    return None
                if right == "utf-8":
                    raw = _whole_sequences(raw, last > 0, start < len(text))
                known = _byte_chars(right)
                try:
                    pieces.append(codecs.charmap_decode(raw, "strict", known[0])[0] if known else raw.decode(right))
                except UnicodeDecodeError:
                    return None
            if end > start:
                pieces.append("�")
                whole = False
            last = end
        text = "".join(pieces)
    return text, whole


def bigrams(text: str) -> np.ndarray:
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8).astype(np.uint32)
    if len(raw) < 2:
        return np.zeros(0, np.int64)
    pairs = raw[:-1] * 256 + raw[1:]
    pairs = pairs[(raw[:-1] > 127) | (raw[1:] > 127)]  # pairs of plain characters tell nothing
    return ((pairs * np.uint32(2654435761)) >> np.uint32(18)).astype(np.int64)


@dataclass
class Model:
    """Log probabilities of the bigrams in each class; class 0 is clean text."""

    logs: np.ndarray
    classes: list[Chain]
    words: frozenset[str] = frozenset()
    prior: float = 4.0

    def __post_init__(self) -> None:
        self.by_bigram = np.ascontiguousarray(self.logs.T)

    def scores(self, text: str) -> np.ndarray:
        found = self.by_bigram[bigrams(text)].sum(axis=0)
        found[0] += self.prior
        return found

    def clean_rate(self, text: str) -> float:
        """Mean log probability of the text's bigrams as clean text; 0 without any."""
        at = bigrams(text)
        return float(self.logs[0, at].mean()) if len(at) else 0.0


_LETTERS = re.compile(r"[^\W\d_]{2,}")
#: A word that restoring a Western token can give.
_WESTERN_WORD = re.compile(f"[{''.join(sorted({c for step in WESTERN for c in bytes(range(256)).decode(step[0], 'ignore').lower() if c.isalpha()}))}]+")


def _fit(clean: list[str], classes: list[Chain], rows: int) -> Model:
    counts = np.full((len(classes) + 1, BUCKETS), 0.02, dtype=np.float64)
    for text in clean:
        np.add.at(counts[0], bigrams(text), 1)
        np.add.at(counts[0], bigrams(text.upper()), 0.2)  # headings in capitals
    for k, chain in enumerate(classes, 1):
        made = 0
        for text in clean:
            if made >= rows:
                break
            if text.isascii():
                continue
            bad = garble(text, chain)
            if bad is not None and bad != text:
                np.add.at(counts[k], bigrams(bad), 1)
                made += 1
    logs = np.log(counts / counts.sum(axis=1, keepdims=True)).astype(np.float32)
    return Model(logs, classes, frozenset(w for text in clean for w in _LETTERS.findall(text.lower())))


def train(texts: list[str], rows: int = ROWS_PER_CHAIN) -> Model:
    """Model from sample texts, some of which may be garbled themselves: those it finds are left out of a second fit.

    Rows of each script take turns, so that `rows` of a chain hold all scripts it can encode.
    """
    by_script: dict[str, list[str]] = {}
    for text in texts:
        odd = re.search(r"[^\x00-ɏ -⁯]", text)
        by_script.setdefault(f"{ord(odd.group()) >> 8:x}" if odd else "", []).append(text)
    turns = [text for i in range(max(map(len, by_script.values()), default=0)) for own in by_script.values() for text in own[i : i + 1]]
    classes = [*chains(), *((step,) for step in WESTERN)]
    first = _fit(turns, classes, max(20, rows // 8))
    kept = [t for t in turns if not find(t, first, western=False)[0]]
    return _fit(kept or turns, classes, rows)


_UNLIKELY = re.compile("[\x00-\x08\x0b-\x1f\x7f-\x9f\ue000-\uf8ff]")
_NON_ASCII = re.compile(r"[^\x00-\x7f]")


def _token(token: str, model: Model) -> tuple[Chain | None, str, float, bool]:
    """(chain or None, restored token, evidence, whether it decodes strictly)."""
    found = _NON_ASCII.findall(token)
    odd, varied = len(found), len(set(found))
    if odd < 2 or token.count("�") == odd:
        return None, token, 0.0, False
    scores = model.scores(token)[: -len(WESTERN)]  # Western chains change too little of a token to be told by it alone
    order = np.argsort(-scores)[:8]
    if order[0] == 0 and scores[0] - scores[order[1]] > 2.0 * odd:
        return None, token, 0.0, False
    before = model.clean_rate(token)
    best = None
    for k in order:
        if k == 0:
            continue
        chain = model.classes[k - 1]
        made = restore(token, chain)
        if made is None or made[0] == token:
            continue
        text, whole = made
        if _UNLIKELY.search(text):
            continue
        multi = chain[-1][0] in TRUE_MULTI
        gain = model.clean_rate(text) - before
        left = len(_NON_ASCII.findall(text))
        enough = odd >= (2 if chain[0][0] == "utf-8" and not chain[0][1] in ("cp1251", "gbk", "cp932") else 4)
        if enough and gain > (0.5 if multi else 2.0) and left and (multi or odd >= 5 and varied >= 4 and scores[k] > scores[0] + odd):
            value = gain * odd
            if best is None or value > best[2]:
                best = (chain, text, value, True)
    if best:
        return best
    lossy = next((k for k in order[:3] if k != 0 and model.classes[k - 1][-1][0] in TRUE_MULTI and model.classes[k - 1][-1][1] in LOSING), None)
    if lossy is not None and order[0] != 0 and scores[lossy] - scores[0] > max(15.0, 1.5 * odd) and odd >= 6 and varied >= 5:
        return model.classes[lossy - 1], token, float(scores[lossy] - scores[0]), False
    return None, token, 0.0, False


def _western(lines: list[str], model: Model, known: dict, words: Collection[str] | None) -> tuple[list[str], float, Chain | None, set[str]]:
    """(lines put right, gain, chain, words asked for) for a Western chain: of the two that the classifier names for
    the text's words (some share most of their characters), the one that makes its lines likelier.

    Only tokens whose restored words are all in `words` speak for a chain; None takes every word for known, which
    gives the largest gain that the text can have.
    """
    best: tuple[float, Chain | None, dict[int, str]] = (0.0, None, {})
    asked: set[str] = set()
    odd_lines = [(n, [t for t in line.split(" ") if not t.isascii()]) for n, line in enumerate(lines) if not line.isascii()]
    scores = np.zeros(len(model.classes) + 1)
    for t in (t for _, tokens in odd_lines for t in tokens):
        own = known.get(("scores", t))
        if own is None:  # tokens that no chain gains anything on say nothing
            own = known["scores", t] = model.scores(t) if any(_western_token(t, step, model)[1] > 0 for step in WESTERN) else np.zeros(len(scores))
        scores += own
    for step in (WESTERN[k] for k in np.argsort(-scores[-len(WESTERN) :], kind="stable")[:2]):
        total, made = 0.0, {}
        for n, tokens in odd_lines:
            gain, worst, to = 0.0, 0.0, {}
            for t in tokens:
                got = known.get((step, t))
                if got is None:
                    got = known[step, t] = _western_token(t, step, model)
                to[t], value = got
                if value > 0:
                    own = _LETTERS.findall(to[t].lower())
                    if words is None:
                        asked.update(own)
                    elif not all(w in words for w in own):
                        value = 0.0
                gain, worst = gain + value, min(worst, value)
            if gain >= LINE_GAIN and worst > -2.0:
                total += gain
                made[n] = " ".join(to.get(t, t) for t in lines[n].split(" "))
        if total > best[0]:
            best = (total, (step,), made)
    total, chain, made = best
    return [made.get(n, line) for n, line in enumerate(lines)], total, chain, asked


def western_bound(text: str, model: Model, known: dict) -> float:
    """No Western chain gains more on the text: the sum of its tokens' largest gains."""
    total = 0.0
    for token in text.replace("\n", " ").split(" "):
        if not token.isascii():
            most = known.get(token)
            if most is None:
                if len(known) > WORDS_IN_MIND:
                    known.clear()
                most = known[token] = max(0.0, *(_western_token(token, step, model)[1] for step in WESTERN))
            total += most
    return total


def _western_token(token: str, step: tuple[str, str], model: Model) -> tuple[str, float]:
    """(restored token, gain if its words are known)."""
    got = restore(token, (step,)) if "\ufffd" not in token else None
    if got is None or got[0] == token or _UNLIKELY.search(got[0]):
        return token, 0.0
    if sum(c.isascii() and c.isalpha() for c in token) < 2:  # signs by themselves say nothing
        return got[0], 0.0
    return got[0], 3.0 * len(_NON_ASCII.findall(token)) * (model.clean_rate(got[0]) - model.clean_rate(token))


def _named(chain: Chain) -> str:
    return " | ".join(f"{right} read as {wrong}" for right, wrong in chain)


def find_western(text: str, model: Model, known: dict, words: Collection[str]) -> tuple[bool, str, bool, str | None]:
    """As `find`, for Western encodings taken for each other alone."""
    lines, gain, chain, _ = _western(text.split("\n"), model, known, words)
    if gain < PAGE_GAIN or chain is None:
        return False, text, False, None
    return True, "\n".join(lines), True, _named(chain)


def find(text: str, model: Model, known: dict | None = None, western: bool = True) -> tuple[bool, str, bool, str | None]:
    """(garbled, text restored as far as it can be, whether all of it was, chain of the strongest evidence)."""
    if text.isascii():
        return False, text, False, None
    known = {} if known is None else known
    strict, weak, lost = 0.0, 0.0, False
    evidence: dict[Chain, float] = {}
    lines = text.split("\n")
    for n, line in enumerate(lines):
        if line.isascii():
            continue
        own: dict[Chain, float] = {}
        tokens = line.split(" ")
        results = []
        for t in tokens:
            made = (None, t, 0.0, False)
            if not t.isascii():
                made = known.get(t)
                if made is None:
                    if len(known) > 200_000:
                        known.clear()
                    made = known[t] = _token(t, model)
            results.append(made)
            if made[0] is not None:
                own[made[0]] = own.get(made[0], 0.0) + made[2]
        if not own:
            continue
        # the chain with most evidence is tried on every token of the line, so that short ones follow the rest
        chain = max(own, key=own.get)
        evidence[chain] = evidence.get(chain, 0.0) + own[chain]
        for i, (t, (mine, to, value, exact)) in enumerate(zip(tokens, results)):
            if t.isascii():
                continue
            again = restore(t, chain) if mine != chain else None
            if again and again[0] != t and not _UNLIKELY.search(again[0]) and (mine is not None or _UNLIKELY.search(t) or model.clean_rate(again[0]) > model.clean_rate(t)):
                to, mine, exact = again[0], chain, exact or mine is None
            if mine is None:
                continue
            tokens[i] = to
            lost |= "\ufffd" in to or not exact
            if exact:
                strict += value if any(right == "utf-8" for right, _ in chain) else value / 15
            else:
                weak += value
        lines[n] = " ".join(tokens)
    made = "\n".join(lines)
    # strict decoding proves little of encodings in which almost any bytes are text: those need more evidence
    if strict < 2.0 and weak < 40.0:
        return find_western(text, model, known, model.words) if western else (False, text, False, None)
    return True, made, not lost, _named(max(evidence, key=evidence.get))


def sample(df: DataFrame, id_column: str, text_column: str, rows: int = SAMPLE_ROWS) -> list[str]:
    """Texts of at most `rows` rows, chosen by the hashes of their ids; of a long text a piece at a hashed place."""
    text = F.col(text_column)
    start = F.pmod(F.xxhash64(id_column, F.lit(5)), F.length(text) - SAMPLE_CHARACTERS + 1).cast("int") + 1
    piece = F.when(F.length(text) <= SAMPLE_CHARACTERS, text).otherwise(F.substring(text, start, F.lit(SAMPLE_CHARACTERS)))
    return [r[1] for r in bounded_sample(df.where(text.isNotNull()), id_column, rows).select(id_column, piece).collect()]


def garbled(df: DataFrame, id_column: str = "page_id", text_column: str = "text", rows: int = SAMPLE_ROWS) -> DataFrame:
    """(id, chain, restored, complete) of the rows that hold wrongly decoded text, in whole or in part.

    A repeated row repeats its result. Null, empty and plain ASCII texts are never found; an empty table gives
    none. `restored` keeps what can't be restored as it is; `complete` says that all of it was restored.
    """
    model = train(sample(df, id_column, text_column, rows))
    shared = df.sparkSession.sparkContext.broadcast((model.logs, model.classes))  # about 130 classes x BUCKETS x 4 bytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows found by other chains; of the rest those that a Western chain may have made, as suspects with the words to be known; new words."""
        model, known, bounds, seen = Model(*shared.value), {}, {}, set()
        row = TaskContext.get().partitionId() << 40
        for batch in in_parts(batches):
            out, words = [], set()
            for i, t in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist()):
                got = find(t, model, known, western=False)
                if got[0]:
                    out.append((i, got[3], got[1], got[2], None, None))
                    continue
                words.update(_LETTERS.findall(t.lower()))
                if t.isascii() or western_bound(t, model, bounds) < PAGE_GAIN:
                    continue
                _, gain, _, asked = _western(t.split("\n"), model, known, None)
                if gain >= PAGE_GAIN:
                    row += 1
                    out.append((i, None, t, None, row, list(asked)))
            words = {w for w in words - seen if _WESTERN_WORD.fullmatch(w)}
            if len(seen) > WORDS_IN_MIND:
                seen.clear()
            seen |= words
            out.append((None, None, None, None, None, list(words)))
            kinds = (batch.schema.field("id").type, pa.string(), pa.string(), pa.bool_(), pa.int64(), pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], ["id", "chain", "restored", "complete", "row", "words"])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, known = Model(*shared.value), {}
        for batch in in_parts(batches):
            rows = [(i, *find_western(t, model, known, frozenset(words or ()))) for i, t, words in zip(*(batch.column(c).to_pylist() for c in ("id", "restored", "words")))]
            rows = [r for r in rows if r[1]]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], batch.schema.field("id").type), pa.array([r[4] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.string()), pa.array([r[3] for r in rows], pa.bool_())], ["id", "chain", "restored", "complete"])

    kind = df.schema[id_column].dataType.simpleString()
    texts = df.select(F.col(id_column).alias("id"), F.col(text_column).alias("text")).where("text is not null")
    made = checkpointed(texts.mapInArrow(run, f"id {kind}, chain string, restored string, complete boolean, row bigint, words array<string>"))
    suspects = made.where("row is not null")
    asked = suspects.select("row", F.explode("words").alias("word"))
    words = made.where("chain is null and row is null").select(F.explode("words").alias("word"))
    held = words.join(asked.select("word").distinct(), "word", "left_semi").distinct()
    known = asked.join(held, "word").groupBy("row").agg(F.collect_list("word").alias("words"))
    western = suspects.select("id", "restored", "row").join(known, "row", "left").select("id", "restored", "words").mapInArrow(judge, f"id {kind}, chain string, restored string, complete boolean")
    return made.where("chain is not null").select("id", "chain", "restored", "complete").unionByName(western).withColumnRenamed("id", id_column)
