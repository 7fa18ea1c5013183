"""Embedding models behind one protocol: texts in, unit vectors out."""

from __future__ import annotations

import hashlib
import json
import re
import time
import urllib.error
import urllib.request
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Embedder(Protocol):
    """Made once in each Python worker; ``dim`` components each, of length one or zero."""

    dim: int

    def embed(self, texts: list[str]) -> np.ndarray: ...


class HashingEmbedder:
    """Signed feature hashing of words: no model file, the same everywhere. It stands in where a model cannot be loaded."""

    def __init__(self, dim: int = 64):
        self.dim = dim

    def embed(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim), np.float32)
        for k, text in enumerate(texts):
            for word in re.findall(r"\w+", text.lower()):
                h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
                out[k, h % self.dim] += 1 if h >> 63 else -1
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(norm == 0, 1, norm)


def as_vectors(out) -> np.ndarray:
    """Rows of length one from what a library's encoder gives: an array, lists, one vector, or any of these under a usual key."""
    if isinstance(out, dict):
        found = [out[k] for k in ("dense_vecs", "embeddings", "sentence_embeddings") if out.get(k) is not None]
        if not found:
            raise ValueError(f"no vectors among {sorted(out)}")
        out = found[0]
    rows = np.atleast_2d(np.asarray(out, np.float32))
    return (rows / (np.linalg.norm(rows, axis=1, keepdims=True) + 1e-9)).astype(np.float32)


class HttpEmbedder:
    """A service that answers a POST of model and prompt with ``embedding``; a text is one call.

    Busy or failing answers and lost connections are tried again, each time after twice the pause; other answers, and
    what fails ``retries`` times more, raise, so that Spark repeats the task and no text is left without its vector.
    """

    BUSY = (429, 500, 502, 503, 504)

    def __init__(self, url: str, model: str, dim: int, *, retries: int = 5, backoff: float = 0.5, pause: float = 0.02, timeout: float = 60, most: int = 8000):
        self.url, self.model, self.dim = url, model, dim
        self.retries, self.backoff, self.pause, self.timeout, self.most = retries, backoff, pause, timeout, most

    def _trim(self, text: str) -> str:
        if len(text) <= self.most:
            return text
        cut = text[: self.most]
        space = cut.rfind(" ")
        return (cut[:space] if space >= 200 else cut) + " …"

    def _one(self, text: str) -> list[float]:
        body = json.dumps({"model": self.model, "prompt": self._trim(text)}).encode()
        asked = urllib.request.Request(self.url, body, {"Content-Type": "application/json"})
        for k in range(self.retries + 1):
            try:
                with urllib.request.urlopen(asked, timeout=self.timeout) as answer:
                    vector = json.load(answer).get("embedding")
                if not isinstance(vector, list) or len(vector) != self.dim:
                    raise ValueError(f"the service gave no vector of {self.dim} components")
                return vector
            except urllib.error.HTTPError as error:
                if error.code not in self.BUSY or k == self.retries:
                    raise
            except (urllib.error.URLError, TimeoutError, ConnectionError):
                if k == self.retries:
                    raise
            time.sleep(self.backoff * 2**k)

    def embed(self, texts: list[str]) -> np.ndarray:
        out = []
        for text in texts:
            out.append(self._one(text))
            time.sleep(self.pause)
        return as_vectors(out) if out else np.zeros((0, self.dim), np.float32)


def with_vectors(rows: DataFrame, make, *, text: str = "chunk_text", vector: str = "vector") -> DataFrame:
    """Rows with the vector of their text; ``make`` builds the embedder in each worker."""

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = make()
        for batch in batches:
            yield pd.Series(list(model.embed(batch.fillna("").tolist())))

    return rows.withColumn(vector, embed(F.col(text)))
