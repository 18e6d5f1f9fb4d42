"""Embedding texts by a pluggable provider; the built-in one hashes words, as no model is at hand."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BATCH = 32


def hashed_words(texts: list[str], dim: int) -> list:
    """Unit vectors of signed word hashes; a text without words gives zeros. Deterministic everywhere."""
    import re
    import zlib

    import numpy as np

    out = np.zeros((len(texts), dim), np.float32)
    for i, t in enumerate(texts):
        for w in re.findall(r"\w+", (t or "").lower()):
            h = zlib.crc32(w.encode())
            out[i, (h >> 1) % dim] += 1 if h & 1 else -1
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return list(np.divide(out, norm, out=np.zeros_like(out), where=norm > 0))


def embed_texts(rows: DataFrame, key: str, text: str, dim: int, provider: Callable[[list[str], int], list] = hashed_words) -> DataFrame:
    """``key, vector, error``: texts go to the provider in batches of 32, after Arrow brought them in larger ones. A
    batch that fails gives its rows an error and no vector; a vector of another length is an error too."""
    src = rows.select(F.col(key).alias("k"), F.col(text).alias("text"))

    def run(frames):
        import pandas as pd

        for pdf in frames:
            vectors, errors = [], []
            texts = [t or "" for t in pdf["text"]]
            for i in range(0, len(texts), BATCH):
                part = texts[i : i + BATCH]
                try:
                    got = provider(part, dim)
                    bad = [len(v) != dim for v in got]
                    vectors += [None if b else v for v, b in zip(got, bad)]
                    errors += ["dimension" if b else None for b in bad]
                except Exception as e:  # a provider may fail in any way
                    vectors += [None] * len(part)
                    errors += [type(e).__name__] * len(part)
            yield pd.DataFrame({"k": pdf["k"], "vector": vectors, "error": errors})

    kind = src.schema["k"].dataType.simpleString()
    return src.mapInPandas(run, f"k {kind}, vector array<float>, error string").withColumnRenamed("k", key)


def whole_documents(embedded: DataFrame, document: str) -> DataFrame:
    """Chunks of documents of which every chunk was embedded; one failure skips the whole document."""
    failed = embedded.filter("error is not null").select(document).distinct()
    return embedded.join(failed, document, "left_anti")
