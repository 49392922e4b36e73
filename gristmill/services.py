"""Clients outside Spark: retries, bounded caches, an embedder that needs no model."""

from __future__ import annotations

import hashlib
import random
import time
from collections import OrderedDict
from collections.abc import Callable, Hashable, Sequence
from typing import Any, Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Embedder(Protocol):
    dim: int

    def embed(self, texts: Sequence[str]) -> np.ndarray: ...


class HashEmbedder:
    """Unit vectors of hashed words: deterministic, offline."""

    def __init__(self, dim: int = 64):
        self.dim = dim

    def embed(self, texts: Sequence[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim), np.float32)
        for row, text in zip(out, texts):
            for word in text.lower().split():
                h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "big")
                row[h % self.dim] += 1 if h >> 63 else -1
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(norm == 0, 1, norm)


#: Instructions before documents and queries.
PREFIXES = {"document": "search_document: ", "query": "search_query: "}


def embedded(rows: DataFrame, text: str, make: Callable[[], Embedder], role: str = "document", batch: int = 64) -> DataFrame:
    """rows with `embedding`, by batches in order; a wrong count or dimension is an error."""
    prefix = PREFIXES[role]

    @F.pandas_udf("array<float>")
    def embed(texts: pd.Series) -> pd.Series:
        model, out = make(), []
        for at in range(0, len(texts), batch):
            part = [prefix + (x or "") for x in texts[at : at + batch]]
            found = np.asarray(model.embed(part))
            if found.shape != (len(part), model.dim):
                raise ValueError(f"embeddings of shape {found.shape}, wanted {(len(part), model.dim)}")
            out.extend(found.astype(np.float32).tolist())
        return pd.Series(out)

    return rows.withColumn("embedding", embed(F.col(text)))


class Final(Exception):
    """An error that no retry mends: a contract or a client error."""


def is_transient(status: int | None) -> bool:
    """Whether a response status (None: no connection, or a timeout) is worth a retry."""
    return status is None or status == 429 or 500 <= status <= 599


def with_retries(call: Callable[[], Any], attempts: int = 3, budget: float = 90.0, first: float = 0.2, most: float = 8.0, sleep=time.sleep, clock=time.monotonic) -> Any:
    """call(), tried again after errors other than Final, with doubled waits inside a time budget."""
    began = clock()
    for attempt in range(1, attempts + 1):
        try:
            return call()
        except Final:
            raise
        except Exception:
            wait = min(most, first * 2 ** (attempt - 1))
            if attempt == attempts or clock() - began + wait > budget:
                raise
            sleep(wait * (1 + 0.1 * random.random()))


class FifoCache:
    """The last `size` keys by first insertion; setting a key again keeps its place."""

    def __init__(self, size: int = 2048):
        self.size, self.held = size, OrderedDict()

    def get(self, key: Hashable):
        return self.held.get(key)

    def put(self, key: Hashable, value) -> None:
        self.held[key] = value
        while len(self.held) > self.size:
            self.held.popitem(last=False)


class TtlCache:
    """Plans by normalised question for `ttl` seconds; hooks see hits and misses."""

    def __init__(self, ttl: float = 300.0, size: int = 256, clock=time.monotonic, hook: Callable[[str, str], None] = lambda event, key: None):
        self.ttl, self.size, self.clock, self.hook, self.held = ttl, size, clock, hook, OrderedDict()

    def get_or(self, question: str, make: Callable[[str], Any]):
        key, now = " ".join(question.lower().split()), self.clock()
        if key in self.held and now - self.held[key][0] < self.ttl:
            self.hook("hit", key)
            return self.held[key][1]
        self.hook("miss", key)
        value = make(question)
        self.held[key] = (now, value)
        self.held.move_to_end(key)
        while len(self.held) > self.size:
            self.held.popitem(last=False)
        return value


def generate(chat: Callable[[str], str], prompt: str, **retry) -> str:
    """The model's answer; an empty one is an error that is not tried again."""

    def once() -> str:
        answer = chat(prompt)
        if not answer or not answer.strip():
            raise Final("empty answer")
        return answer

    return with_retries(once, **retry)
