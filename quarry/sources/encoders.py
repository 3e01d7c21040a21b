"""Text encoders: hashed words in the plan itself, or an HTTP embeddings service per partition."""

from __future__ import annotations

import json
import math
import urllib.request
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.operators.vectors import hashed

#: Texts of one request.
BATCH = 64
#: Prompts of model families, by the longest part of the model's name.
FAMILIES = {"e5": ("query: ", "passage: "), "bge": ("Represent this sentence for searching relevant passages: ", ""), "nomic": ("search_query: ", "search_document: ")}


def prefixes(model: str, query: str | None = None, doc: str | None = None) -> tuple[str, str]:
    """Explicit prefixes, where set, over the family's; an empty one is set, an absent one is not."""
    family = max((f for f in FAMILIES if f in model.lower()), key=len, default=None)
    own = FAMILIES.get(family, ("", ""))
    return own[0] if query is None else query, own[1] if doc is None else doc


def ordered(reply: dict, n: int) -> list[list[float]]:
    """Vectors by their index; refuses missing, repeated or odd indices and unequal or non-finite vectors."""
    rows = {d["index"]: d["embedding"] for d in reply["data"]}
    if len(reply["data"]) != n or sorted(rows) != list(range(n)):
        raise ValueError("the service left out or repeated an index")
    out = [list(map(float, rows[i])) for i in range(n)]
    if len({len(v) for v in out}) > 1 or not all(v and all(map(math.isfinite, v)) for v in out):
        raise ValueError("the service gave empty, unequal or non-finite vectors")
    return out


def ask(endpoint: str, model: str, texts: list[str], key: str = "", timeout: int = 60) -> list[list[float]]:
    body = json.dumps({"model": model, "input": texts}).encode()
    head = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {key}"} if key else {})
    with urllib.request.urlopen(urllib.request.Request(endpoint, body, head), timeout=timeout) as r:
        return ordered(json.load(r), len(texts))


def encoded(items: DataFrame, text: str, backend: str = "static", endpoint: str = "", model: str = "", key: str = "") -> DataFrame:
    """`vec` beside the items' columns."""
    if backend != "http":
        return items.withColumn("vec", hashed(F.col(text)))
    from pyspark.sql import types as T

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            texts = f[text].fillna("").tolist()
            vecs = [v for a in range(0, len(texts), BATCH) for v in ask(endpoint, model, texts[a : a + BATCH], key)]
            yield f.assign(vec=vecs)

    return items.mapInPandas(run, T.StructType([*items.schema.fields, T.StructField("vec", T.ArrayType(T.DoubleType()))]))
