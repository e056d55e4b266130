"""Embedding of symbol texts: a protocol for models, a default that needs none, and the upkeep of stored vectors."""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodegraph.operators.evolution import stale_embeddings
from lodegraph.storage import Catalog

BATCH = 256
_WORD = re.compile(r"[^\W_]+")


class Embedder(Protocol):
    """Sent to the executors as it is, so it must pickle."""

    dimensions: int

    def embed_batch(self, texts: list[str]) -> np.ndarray: ...


class HashingEmbedder:
    """Words hashed to signed places, scaled to length 1; a text without words is the zero vector."""

    def __init__(self, dimensions: int = 384):
        self.dimensions = dimensions

    def embed_batch(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dimensions), np.float32)
        for row, text in zip(out, texts):
            for word in _WORD.findall(text.lower()):
                h = xxhash.xxh3_64_intdigest(word)
                row[(h >> 1) % self.dimensions] += 1.0 if h & 1 else -1.0
        size = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, size, out=out, where=size > 0)


def embed(texts: DataFrame, embedder: Embedder) -> DataFrame:
    """symbol_id, body_hash, embedding of (id, body_hash, text); a null text is empty."""
    kind = texts.schema["id"].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for at in range(0, len(f), BATCH):
                part = f.iloc[at : at + BATCH]
                vectors = embedder.embed_batch([t or "" for t in part["text"]])
                yield pd.DataFrame({"symbol_id": part["id"].to_numpy(), "body_hash": part["body_hash"].to_numpy(), "embedding": list(vectors)})

    return texts.select("id", "body_hash", "text").mapInPandas(run, f"symbol_id {kind}, body_hash string, embedding array<float>")


def refresh(catalog: Catalog, texts: DataFrame, embedder: Embedder, name: str = "embeddings") -> DataFrame:
    """Stored vectors after those of new and altered symbols were embedded again; the rest stay as they are."""
    wanted = texts
    if catalog.exists(name):
        wanted = texts.join(stale_embeddings(texts, catalog.read(name)).select("id"), "id", "left_semi")
    return catalog.upsert(name, embed(wanted, embedder), ["symbol_id"])
