"""Models outside the engine as plain callables: embeddings in Arrow batches, language models and OCR on request."""

from __future__ import annotations

import json
import math
import re
import subprocess
import time
import urllib.request
import zlib
from collections.abc import Callable, Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectorium.schema import OCR_RETRY_CHARS

#: texts to vectors; called on executors with at most a batch of texts.
Embedder = Callable[[Sequence[str]], list[list[float]]]
#: (system, user) to answer; called on the driver.
LanguageModel = Callable[[str, str], str]
#: image bytes to lines of text.
Ocr = Callable[[bytes], list[str]]

RETRY_DELAYS_S = (0.1, 0.5, 2.0)


class HashingEmbedder:
    """Deterministic vectors without a model: signed hashes of words and their trigrams, unit length."""

    def __init__(self, dimension: int = 64):
        self.dimension = dimension

    def one(self, text: str) -> list[float]:
        vector = [0.0] * self.dimension
        for word in re.findall(r"\w+", text.lower()):
            for piece in (word, *(word[i : i + 3] for i in range(max(0, len(word) - 2)))):
                h = zlib.crc32(piece.encode())
                vector[h % self.dimension] += 1.0 if h >> 31 else -1.0
        size = math.sqrt(sum(x * x for x in vector)) or 1.0
        return [x / size for x in vector]

    def __call__(self, texts: Sequence[str]) -> list[list[float]]:
        return [self.one(t) for t in texts]


class HttpEmbedder:
    """Client of an embedding server: POST {model, input} to <url>/api/embed."""

    def __init__(self, url: str, model: str, attempts: int = 3, timeout_s: float = 60):
        self.url, self.model, self.attempts, self.timeout_s = url.rstrip("/"), model, attempts, timeout_s

    def __call__(self, texts: Sequence[str]) -> list[list[float]]:
        body = json.dumps({"model": self.model, "input": list(texts)}).encode()
        for attempt in range(self.attempts):
            try:
                request = urllib.request.Request(f"{self.url}/api/embed", body, {"Content-Type": "application/json"})
                with urllib.request.urlopen(request, timeout=self.timeout_s) as answer:  # noqa: S310
                    vectors = json.load(answer).get("embeddings") or []
                if len(vectors) != len(texts) or not all(vectors):
                    raise ValueError("an embedding is missing")
                return vectors
            except Exception:
                if attempt + 1 >= self.attempts:
                    raise
                time.sleep(RETRY_DELAYS_S[min(attempt, len(RETRY_DELAYS_S) - 1)])
        return []

    def healthy(self) -> bool:
        """Whether the server answers and lists the model, with or without the tag latest."""
        try:
            with urllib.request.urlopen(f"{self.url}/api/tags", timeout=5) as answer:  # noqa: S310
                names = {m.get("name") for m in json.load(answer).get("models", [])}
        except (OSError, ValueError):
            return False
        return self.model in names or f"{self.model}:latest" in names


def embed(df: DataFrame, embedder: Embedder, id_column: str = "chunk_id", text_column: str = "body", batch_size: int = 64) -> DataFrame:
    """(id, embedding) of each text. A batch that fails is tried text by text; one that fails alone has a null vector."""

    def attempt(texts: list[str]) -> list[list[float] | None]:
        try:
            made = embedder(texts)
            if len(made) == len(texts):
                return list(made)
        except Exception:  # noqa: BLE001 - a failing batch is split, a failing text is null
            pass
        return [None] if len(texts) == 1 else [v for t in texts for v in attempt([t])]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = batch["text"].fillna("").tolist()
            vectors = [v for i in range(0, len(texts), batch_size) for v in attempt(texts[i : i + batch_size])]
            yield pd.DataFrame({"id": batch["id"], "embedding": vectors})

    kind = df.schema[id_column].dataType.simpleString()
    rows = df.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    return rows.mapInPandas(run, f"id {kind}, embedding array<float>").withColumnRenamed("id", id_column)


class CommandModel:
    """Language model as a command: the prompt goes to its standard input, the answer comes from its output."""

    def __init__(self, command: Sequence[str], timeout_s: float = 60):
        self.command, self.timeout_s = list(command), timeout_s

    def __call__(self, system: str, user: str) -> str:
        done = subprocess.run(self.command, input=f"{system}\n\n{user}", capture_output=True, text=True, timeout=self.timeout_s, check=True)
        return done.stdout.strip()


class HttpModel:
    """Language model behind a message API: POST {model, max_tokens, system, messages}, answered by a list of content blocks.

    An answer of another status than 200, or without text, is an error.
    """

    def __init__(self, url: str, model: str, api_key: str = "", max_tokens: int = 2048, timeout_s: float = 60, headers: Mapping[str, str] | None = None):
        self.url, self.model, self.api_key, self.max_tokens, self.timeout_s, self.headers = url, model, api_key, max_tokens, timeout_s, dict(headers or {})

    def __call__(self, system: str, user: str) -> str:
        body = json.dumps({"model": self.model, "max_tokens": self.max_tokens, "system": system, "messages": [{"role": "user", "content": user}]}).encode()
        headers = {"Content-Type": "application/json", **({"x-api-key": self.api_key} if self.api_key else {}), **self.headers}
        with urllib.request.urlopen(urllib.request.Request(self.url, body, headers), timeout=self.timeout_s) as answer:  # noqa: S310
            made = json.load(answer)
        text = "".join(block.get("text", "") for block in made.get("content", []) if block.get("type", "text") == "text")
        if not text.strip():
            raise ValueError("the model gave no answer")
        return text


OCR_STATS = ("ocr_pages", "ocr_retries", "ocr_fast_pages", "ocr_retry_pages", "ocr_ms", "ocr_fast_ms", "ocr_retry_ms")


def read_scans(pages: DataFrame, fast: Ocr | None, accurate: Ocr | None, policy: str = "auto", retry_chars: int = OCR_RETRY_CHARS) -> DataFrame:
    """Pages (.., text, image) with OCR where the text is blank, and the counters of OCR_STATS.

    `auto` reads fast and again accurately where that gives few characters, keeping the longer text;
    `accurate-only` reads once; `never`, or no reader, reads nothing. A reader that fails gives no lines.
    """
    if policy not in ("auto", "accurate-only", "never"):
        raise ValueError(f"unknown OCR policy: {policy}")
    solid = re.compile(r"\s+")

    def read(reader: Ocr | None, image: bytes) -> tuple[str, int]:
        began = time.perf_counter()
        try:
            text = "\n".join(reader(image)) if reader else ""
        except Exception:  # noqa: BLE001 - a page that can't be read stays blank
            text = ""
        return text, int((time.perf_counter() - began) * 1000)

    def one(text: str | None, image: bytes | None) -> tuple:
        stats = dict.fromkeys(OCR_STATS, 0)
        text = text or ""
        first = accurate if policy == "accurate-only" else fast
        if text.strip() or policy == "never" or first is None or image is None:
            return (text, *stats.values())
        text, ms = read(first, image)
        stats |= {"ocr_pages": 1, "ocr_ms": ms}
        if policy == "auto":
            stats |= {"ocr_fast_pages": 1, "ocr_fast_ms": ms}
            if len(solid.sub("", text)) < retry_chars:
                again, more = read(accurate, image)
                stats |= {"ocr_retries": 1, "ocr_retry_pages": 1, "ocr_retry_ms": more, "ocr_ms": ms + more}
                text = again if len(solid.sub("", again)) > len(solid.sub("", text)) else text
        return (text, *stats.values())

    keys = [c for c in pages.columns if c not in ("text", "image")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [one(t if isinstance(t, str) else None, i) for t, i in zip(batch["text"], batch["image"])]
            yield pd.concat([batch[keys].reset_index(drop=True), pd.DataFrame(rows, columns=["text", *OCR_STATS])], axis=1)

    kinds = ", ".join(f"`{k}` {pages.schema[k].dataType.simpleString()}" for k in keys)
    return pages.mapInPandas(run, f"{kinds}, text string, " + ", ".join(f"{s} bigint" for s in OCR_STATS))


def answer(model: LanguageModel, system: str, user: str) -> str:
    """The model's answer; an empty one is an error."""
    text = model(system, user)
    if not text or not text.strip():
        raise ValueError("the model gave no answer")
    return text
