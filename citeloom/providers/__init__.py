"""Models and other outside services behind small protocols, with deterministic stand-ins (UDF-1 to UDF-12, VEC-3, SRC-6, SRC-7)."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class LLM(Protocol):
    def generate(self, system: str, user: str, max_tokens: int = 1024) -> str: ...


class Embedder(Protocol):
    def embed(self, texts: list[str]) -> np.ndarray: ...


class Fetcher(Protocol):
    def fetch(self, url: str) -> tuple[str, bytes]:
        """(content type, body); raises where the page can't be had."""
        ...


class EchoLLM:
    """Replies by rules on the prompt alone, so that runs repeat: lists, letters or the prompt's last line."""

    def generate(self, system: str, user: str, max_tokens: int = 1024) -> str:
        ask = system.lower()
        if "json list" in ask:
            parts = [p.strip() for p in user.split("[KP]")]
            return "[" + ", ".join('"' + p.replace('"', "'") + '"' for p in parts[:-1]) + "]"
        if "grounded" in ask:
            claim, _, evidence = user.partition("\n")
            return "Grounded" if set(claim.lower().split()) <= set(evidence.lower().split()) else "Not Grounded"
        if "letter" in ask:
            gold, _, said = user.partition("\n")
            return "A" if gold.strip().lower() in said.lower() else "B"
        return " ".join(user.strip().split("\n")[-1].split()[:max_tokens])


class HashEmbedder:
    """Signed feature hashing of words to unit vectors."""

    def __init__(self, size: int = 64, prefix: str = ""):
        self.size, self.prefix = size, prefix

    def embed(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.size), np.float32)
        for i, t in enumerate(texts):
            for w in (self.prefix + (t or "")).lower().split():
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
                out[i, h % self.size] += 1 if h >> 63 else -1
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(norm == 0, 1, norm)


REGISTRY: dict[str, Callable[..., object]] = {"echo": EchoLLM, "hash": HashEmbedder}


def register(name: str, factory: Callable[..., object]) -> None:
    """UDF-2: a name for a provider; adapters for hosted models register here and are never needed by tests."""
    REGISTRY[name] = factory


def provider(name: str, **options):
    if name not in REGISTRY:
        raise ValueError(f"unknown provider {name}; known: {', '.join(sorted(REGISTRY))}")
    return REGISTRY[name](**options)


def generate(df: DataFrame, name: str, system: Column, user: Column, out: str = "reply", max_tokens: int = 1024, on_error: str | None = None, tasks: int | None = None, **options) -> DataFrame:
    """A column of replies. One provider per task; errors give on_error. `tasks` bounds the calls at once (RATE-2)."""
    schema = df.schema.add(out, "string")
    rows = df.withColumn("_system", system).withColumn("_user", user)
    rows = rows.repartition(tasks) if tasks else rows

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = provider(name, **options)

        def one(s: str, u: str) -> str | None:
            try:
                return model.generate(s or "", u or "", max_tokens)
            except Exception:
                return on_error

        for b in batches:
            b[out] = [one(s, u) for s, u in zip(b["_system"], b["_user"])]
            yield b.drop(columns=["_system", "_user"])

    return rows.mapInPandas(run, schema)


def embed(df: DataFrame, name: str, text: str, key: str, out: str = "embedding", **options) -> DataFrame:
    """VEC-3: (key, out) with one vector per row."""
    kind = dict(df.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = provider(name, **options)
        for b in batches:
            yield pd.DataFrame({key: b[key], out: list(model.embed(list(b[text].fillna(""))))})

    return df.select(key, F.col(text).alias(text)).mapInPandas(run, f"`{key}` {kind}, `{out}` array<float>")


def crawl(urls: DataFrame, fetcher: Fetcher, read: Callable[[str, bytes], str], tasks: int = 10) -> DataFrame:
    """SRC-6, SRC-7, RATE-2: (url, accessible, content) of admitted URLs; a failure gives its message as content. At most `tasks` fetches at once."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for u in b["url"]:
                try:
                    kind, body = fetcher.fetch(u)
                    if "html" not in kind:
                        out.append((u, False, f"Content type is {kind}"))
                    else:
                        text = read(kind, body)
                        out.append((u, bool(text), text or "Empty HTML content"))
                except Exception as e:
                    out.append((u, False, str(e)))
            yield pd.DataFrame(out, columns=["url", "accessible", "content"])

    return urls.select("url").distinct().repartition(tasks).mapInPandas(run, "url string, accessible boolean, content string")


# UDF-11: short templates of our own
PROMPTS = {
    "keypoints": "Rewrite each part of the fact that ends with [KP] as one short statement. Answer with a JSON list.",
    "groundedness": "Say Grounded if the evidence supports the claim, else Not Grounded.",
    "graph": "List the relations of the statement as JSON edges with head, head_type, relation, tail and tail_type.",
    "completeness": "Does the graph say all that the statement says? Answer with a letter: A. yes, B. no.",
    "question": "Ask for the unknown of the graph in one sentence.",
    "refinement": "Rewrite the question so that it reads naturally and keeps its meaning.",
    "answerability": "Is there one answer only? Answer with a letter: A. no, B. yes.",
    "answer": "Answer the question from the contexts; say I don't know if they don't tell.",
    "judge": "Compare the answer with the gold. Answer with a letter: A correct, B incorrect, C not attempted.",
}
