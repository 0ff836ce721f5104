"""Encoding of a corpus with a public byte-level BPE vocabulary by a traversal of a prefix trie.

The last token of the encoding of a byte string w is the one token t for which (last token of w without t, t)
can stand side by side in a BPE encoding. So the state of a prefix is just its last token, and all words that
share a prefix share its states. The distinct words of a batch are walked in sorted order, which is the
depth-first order of their trie: a stack keeps the last token of each prefix of the current path, and a word
only adds states below the deepest node it shares with the word before.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectorium.llm.common import in_parts, local_file, shared_file, vocabulary_path

#: Fixed value: the word pattern that belongs to the byte_bpe_50k vocabulary.
WORD_PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""

#: Words kept with their encodings from batch to batch of one task; beyond it the store starts anew (only speed changes).
KEPT_WORDS = 300_000


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


class TrieEncoder:
    """Encodes words, sharing the work on common prefixes."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.length = {i: len(t) for t, i in ranks.items()}
        self.backward = self._backward(ranks)
        self.halves = self._halves(ranks)
        self.merged = {pair: t for t, pair in self.halves.items() if pair[0] != t}
        self.beside: dict[tuple[int, int], bool] = {}
        self.words: dict[str, list[int]] = {}
        self.pattern = regex.compile(WORD_PATTERN)

    @staticmethod
    def _backward(ranks: dict[bytes, int]) -> dict:
        """Trie of the tokens read from their ends; key -1 holds the token that is complete there."""
        root: dict = {}
        for token, rank in ranks.items():
            node = root
            for byte in reversed(token):
                node = node.setdefault(byte, {})
            node[-1] = rank
        return root

    @staticmethod
    def _halves(ranks: dict[bytes, int]) -> dict[int, tuple[int, int]]:
        """For each token the two tokens whose merge makes it; a single byte stands for itself."""
        halves = {}
        for token, rank in ranks.items():
            if len(token) == 1:
                halves[rank] = (rank, rank)
                continue
            parts = [ranks[bytes([b])] for b in token]
            spans = [bytes([b]) for b in token]
            while len(spans) > 2:
                best, at = None, -1
                for i in range(len(spans) - 1):
                    r = ranks.get(spans[i] + spans[i + 1])
                    if r is not None and r < rank and (best is None or r < best):
                        best, at = r, i
                if at < 0:
                    break
                spans[at : at + 2] = [spans[at] + spans[at + 1]]
                parts[at : at + 2] = [best]
            halves[rank] = (parts[0], parts[1]) if len(parts) == 2 else (rank, rank)
        return halves

    def _side_by_side(self, left: int, right: int) -> bool:
        """Whether a BPE encoding may hold `left` directly before `right`: no merge across their border comes first."""
        key = (left, right)
        known = self.beside.get(key)
        if known is None:
            known = self.beside[key] = self._unmerged(left, right)
        return known

    def _unmerged(self, left: int, right: int) -> bool:
        # Undo the merges of both tokens, the latest first. The border pair that stood there would have been
        # merged, unless the merge just undone came before that merge.
        bound = 1 << 60
        while True:
            across = self.merged.get((left, right))
            if across is not None and across < bound:
                return False
            a, b = self.halves[left], self.halves[right]
            open_left, open_right = a[0] != left, b[0] != right
            if not open_left and not open_right:
                return True
            if open_left and (left > right or not open_right):
                bound, left = left, a[1]
            else:
                bound, right = right + 1, b[0]

    def encode_words(self, words: Iterable[str]) -> None:
        """Adds the encodings of `words` to the store."""
        path = b""
        last: list[int] = []  # last[i]: last token of path[: i + 1]
        backward, length, side_by_side = self.backward, self.length, self._side_by_side
        for raw, word in sorted((w.encode("utf-8", "surrogatepass"), w) for w in words):
            shared = 0
            for x, y in zip(path, raw):
                if x != y:
                    break
                shared += 1
            del last[shared:]
            path = raw
            for i in range(shared, len(raw)):
                node, j, found = backward, i, -1
                while j >= 0:
                    node = node.get(raw[j])
                    if node is None:
                        break
                    token = node.get(-1)
                    j -= 1
                    if token is not None and (j < 0 or side_by_side(last[j], token)):
                        if j >= 0 or self.halves[token][0] != token or length[token] == 1:
                            found = token
                            break
                last.append(found)
            ids, i = [], len(raw) - 1
            while i >= 0:
                ids.append(last[i])
                i -= length[last[i]]
            ids.reverse()
            self.words[word] = ids

    def encode_texts(self, texts: list[str | None]) -> list[list[int]]:
        """Token ids of each text; null and empty texts give an empty list."""
        split = [self.pattern.findall(t) if t else [] for t in texts]
        if len(self.words) > KEPT_WORDS:
            self.words.clear()
        self.encode_words({w for ws in split for w in ws}.difference(self.words))
        words = self.words
        return [[i for w in ws for i in words[w]] for ws in split]


_encoders: dict[str, TrieEncoder] = {}


def encoder(path: str) -> TrieEncoder:
    """One encoder for each vocabulary and Python worker."""
    if path not in _encoders:
        _encoders[path] = TrieEncoder(load_ranks(local_file(path)))
    return _encoders[path]


def _each_batch(batches: Iterator[pa.RecordBatch], path: str, column: str) -> Iterator[tuple[pa.RecordBatch, list[list[int]]]]:
    for batch in in_parts(batches):
        yield batch, encoder(path).encode_texts(batch.column(column).to_pylist())


def encode_corpus(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", path: str | None = None) -> DataFrame:
    """(id, ids) with the token ids of each text, without special tokens.

    No shuffle: each task builds the tries of its own batches and keeps what it encoded. Null and empty texts
    give an empty list; a null id keeps its row; repeated rows repeat their result; an empty table gives none.
    Other columns of the input are ignored.
    """
    path = shared_file(df.sparkSession, path or vocabulary_path("byte_bpe_50k.tiktoken"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, ids in _each_batch(batches, path, "text"):
            ends = np.zeros(len(ids) + 1, dtype=np.int32)
            np.cumsum([len(x) for x in ids], out=ends[1:])
            flat = np.fromiter((i for x in ids for i in x), dtype=np.int32, count=int(ends[-1]))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], ["id", "ids"])

    kind = df.schema[id_column].dataType.simpleString()
    out = df.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text")).mapInArrow(run, f"id {kind}, ids array<int>")
    return out.withColumnRenamed("id", id_column)


def count_tokens(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", path: str | None = None) -> DataFrame:
    """(id, tokens) with the number of tokens of each text; null and empty texts have 0."""
    path = shared_file(df.sparkSession, path or vocabulary_path("byte_bpe_50k.tiktoken"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, ids in _each_batch(batches, path, "text"):
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([len(x) for x in ids], pa.int64())], ["id", "tokens"])

    kind = df.schema[id_column].dataType.simpleString()
    out = df.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text")).mapInArrow(run, f"id {kind}, tokens bigint")
    return out.withColumnRenamed("id", id_column)
