"""Language models and embeddings behind pluggable functions, called once per Arrow batch on the executors.

The offline defaults are deterministic: a tagger that answers from the words of a place, a writer
that lists a day's stops, an embedding of hashed words.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from placeloom.config import BEHAVIORS, INTERESTS

Answer = Callable[[str], str]
Embed = Callable[[list[str]], np.ndarray]


def offline_tagger(prompt: str) -> str:
    """Tags and behaviours picked by a digest of the prompt, as a model's JSON answer."""
    n = int(hashlib.md5(prompt.encode()).hexdigest()[:8], 16)
    name = re.search(r"^名称：(.*)$", prompt, re.MULTILINE)
    return json.dumps({"is_attraction": True, "tags": INTERESTS[n % len(INTERESTS)], "behaviors": ",".join(BEHAVIORS[(n + i) % len(BEHAVIORS)] for i in (0, 5)), "description": name[1] if name else ""}, ensure_ascii=False)


def offline_writer(prompt: str) -> str:
    """The day's lines as the day's text."""
    return "\n".join(re.findall(r"^\d+\. .*$", prompt, re.MULTILINE))


def http_model(endpoint: str, key: str, model: str, temperature: float = 0.0, timeout_s: float = 60.0) -> Answer:
    """A chat model over HTTP: the prompt's part before the first empty line is the system message, the rest the user's; any answer without a message is an error."""
    import urllib.request

    def answer(prompt: str) -> str:
        system, _, user = prompt.partition("\n\n")
        said = [{"role": "system", "content": system}, {"role": "user", "content": user}] if user else [{"role": "user", "content": system}]
        body = json.dumps({"model": model, "temperature": temperature, "messages": said}).encode()
        request = urllib.request.Request(endpoint, body, {"Content-Type": "application/json", "Authorization": f"Bearer {key}"})
        with urllib.request.urlopen(request, timeout=timeout_s) as got:
            return json.load(got)["choices"][0]["message"]["content"]

    return answer


def hashed_embedding(size: int = 64) -> Embed:
    """Unit vectors of signed hashed words and character pairs."""

    def embed(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), size))
        for i, t in enumerate(texts):
            words = re.findall(r"\w+", t.lower())
            for w in words + [x[j : j + 2] for x in words for j in range(len(x) - 1)]:
                h = int(hashlib.md5(w.encode()).hexdigest()[:8], 16)
                out[i, h % size] += 1 if h >> 31 else -1
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)

    return embed


def answered(df: DataFrame, prompt: str, answer: Answer, into: str, on_error: Callable[[str], str] = lambda e: "") -> DataFrame:
    """``df`` with the model's answers to a column of prompts; an error becomes ``on_error`` of its text, never a failed job."""

    def one(p: str) -> str:
        try:
            return answer(p)
        except Exception as e:  # noqa: BLE001  whatever a remote model raises
            return on_error(str(e))

    @pandas_udf("string")
    def ask(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for prompts in batches:
            yield prompts.map(one)

    return df.withColumn(into, ask(F.col(prompt)))


def embedded(df: DataFrame, text: str = "text", embed: Embed | None = None, into: str = "embedding") -> DataFrame:
    """``df`` with an embedding (array of float) of a text column."""
    make = embed or hashed_embedding()

    @pandas_udf("array<float>")
    def vectors(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(list(make(texts.fillna("").tolist()).astype("float32")))

    return df.withColumn(into, vectors(F.col(text)))
