"""Model-backed steps behind small protocols, with deterministic offline defaults."""

from __future__ import annotations

import hashlib
import json
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import lru_cache
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X


class Chat(Protocol):
    def complete(self, role: str, messages: list[dict], json_mode: bool = False) -> str: ...


class Embedder(Protocol):
    """``embed`` takes at most ``batch_size`` texts and gives a vector each, in their order."""

    batch_size: int

    def embed(self, texts: list[str]) -> list[list[float]]: ...


def retried(call: Callable, tries: int = 3, pause: float = 0.5):
    """``call()``, again after a pause that doubles where a server is busy or can't be reached."""
    for i in range(tries):
        try:
            return call()
        except urllib.error.HTTPError as e:
            if i + 1 == tries or (e.code < 500 and e.code != 429):
                raise
        except (urllib.error.URLError, TimeoutError, ConnectionError):
            if i + 1 == tries:
                raise
        time.sleep(pause * 2**i)


def _post(url: str, api_key: str, payload: dict, timeout: float) -> dict:
    head = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {api_key}"} if api_key else {})
    request = urllib.request.Request(url, json.dumps(payload).encode(), head)
    with urllib.request.urlopen(request, timeout=timeout) as reply:
        return json.loads(reply.read())


@dataclass
class HttpChat:
    """A chat service with one model a role; ``roles`` has ``model``, ``max_tokens`` and ``temperature`` of each."""

    base_url: str
    api_key: str = ""
    roles: dict[str, dict] = field(default_factory=dict)
    timeout: float = 60.0
    tries: int = 3

    def complete(self, role: str, messages: list[dict], json_mode: bool = False) -> str:
        payload = {**self.roles.get(role, {}), "messages": messages} | ({"response_format": {"type": "json_object"}} if json_mode else {})
        found = retried(lambda: _post(f"{self.base_url.rstrip('/')}/chat/completions", self.api_key, payload, self.timeout), self.tries)
        return found["choices"][0]["message"]["content"]


@dataclass
class HttpEmbedder:
    """An embedding service; its reply may have the vectors in any order, with their places."""

    base_url: str
    model: str
    api_key: str = ""
    dimensions: int = 0
    batch_size: int = 64
    timeout: float = 120.0
    tries: int = 3

    def embed(self, texts: list[str]) -> list[list[float]]:
        payload = {"model": self.model, "input": texts} | ({"dimensions": self.dimensions} if self.dimensions else {})
        data = retried(lambda: _post(f"{self.base_url.rstrip('/')}/embeddings", self.api_key, payload, self.timeout), self.tries)["data"]
        return [d["embedding"] for d in sorted(data, key=lambda d: d["index"])]


#: Words whose hashes a worker of the offline embedder keeps, about 200 bytes each.
WORDS = 1 << 16


@dataclass
class OfflineEmbedder:
    """Signed hashed words, scaled to length one; the same text always has the same vector."""

    dimensions: int = 64
    batch_size: int = 64

    def embed(self, texts: list[str]) -> list[list[float]]:
        return [embed_text(t, self.dimensions) for t in texts]


@lru_cache(WORDS)
def _placed(word: str) -> tuple[int, float]:
    """A word's place, to be taken modulo the dimensions, and its sign."""
    digest = hashlib.sha256(word.encode()).digest()
    return int.from_bytes(digest[4:8], "big"), 1.0 if digest[0] >= 128 else -1.0


def embed_text(text: str, dimensions: int = 64) -> list[float]:
    """The offline embedding of one text, in one pass over its words."""
    out = [0.0] * dimensions
    for place, sign in map(_placed, text.lower().split()):
        out[place % dimensions] += sign
    norm = sum(x * x for x in out) ** 0.5
    return [x / norm for x in out] if norm else out


#: Requests that one task has under way.
CONCURRENCY = 4
#: Most rows of an Arrow batch of texts to embed.
TEXTS = 1_000


def embedded(chunks: DataFrame, embedder: Embedder | None = None, column: str = "content") -> DataFrame:
    """``chunks`` with an ``embedding`` of a text column, null where the service failed for its batch after all tries.

    Texts stream to the service in batches of ``batch_size``, a few at once in each task. The session's Arrow batches are held to
    TEXTS rows, so that a task has few whole texts at a time, however many its part of the input holds.
    """
    service = embedder or OfflineEmbedder()
    conf, name = chunks.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(name, "10000")) <= TEXTS:
        conf.set(name, str(TEXTS))

    def batch(texts: list[str]) -> list[list[float] | None]:
        try:
            found = service.embed(texts)
            return found if len(found) == len(texts) else [None] * len(texts)
        except Exception:  # whatever a service raises: these texts have no vector, and the caller sees which
            return [None] * len(texts)

    def read(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        with ThreadPoolExecutor(CONCURRENCY) as pool:
            for part in parts:
                texts = [t or "" for t in part.to_pylist()]
                cut = [texts[i : i + service.batch_size] for i in range(0, len(texts), service.batch_size)]
                yield pa.array([v for vectors in pool.map(batch, cut) for v in vectors], pa.list_(pa.float32()))

    return chunks.withColumn("embedding", F.arrow_udf(read, "array<float>", F.ArrowUDFType.SCALAR_ITER)(F.col(column)))


def complete_json(chat: Chat, role: str, messages: list[dict]):
    """A JSON reply, without the code fence some models put around it."""
    reply = chat.complete(role, messages, json_mode=True).strip()
    if reply.startswith("```"):
        reply = reply.split("\n", 1)[-1].rsplit("```", 1)[0]
    return json.loads(reply)


def replies(rows: DataFrame, chat: Chat, role: str, system: str, prompt: Column) -> DataFrame:
    """``rows`` with the model's ``reply`` to a prompt each, or the ``problem`` that kept it away; a few requests at once in each task."""

    def ask(text: str) -> tuple[str | None, str | None]:
        try:
            return chat.complete(role, [{"role": "system", "content": system}, {"role": "user", "content": text}], json_mode=True), None
        except Exception as e:  # one failing reply is a row of its own, not a failed job
            return None, type(e).__name__

    def read(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        with ThreadPoolExecutor(CONCURRENCY) as pool:
            for part in parts:
                got = list(pool.map(ask, part.to_pylist()))
                yield pa.StructArray.from_arrays([pa.array([g[i] for g in got], pa.string()) for i in (0, 1)], ["reply", "problem"])

    answer = F.arrow_udf(read, "struct<reply:string,problem:string>", F.ArrowUDFType.SCALAR_ITER)(prompt)
    return rows.withColumn("answer", answer).select("*", "answer.reply", "answer.problem").drop("answer")


# Fixed value: what the model is asked for, whose reply's form the parser below needs.
FACT_PROMPT = (
    "Extract specific, searchable facts (contacts, codes, dates, prices, relations, decisions) from the body of the note. "
    "Leave out its frontmatter and general knowledge. Reply with a JSON array of objects with entity, key, value and context; [] if there are none."
)
_FACT_FIELDS = ("entity", "key", "value", "context")


def model_facts(notes: DataFrame, chat: Chat) -> DataFrame:
    """Facts of ``notes(path, title, content)`` as a model names them: the columns of ``extract_facts``, and a ``problem``.

    The reply is parsed JVM-side. What is no array gives no facts; elements that are no objects are left out, but count in the
    places that ids are made from. A note whose request failed or whose reply is no JSON array has one row with only path, title and problem.
    """
    prompt = F.concat(F.lit("Note title: "), "title", F.lit("\nNote path: "), "path", F.lit("\n\nContent:\n"), "content")
    told = replies(notes.select("path", "title", "content"), chat, "extractor", FACT_PROMPT, prompt)
    body = X.strip_fences(F.col("reply"))
    parts = F.when(body.startswith("["), F.from_json(body, "array<string>"))
    read = told.select("path", "title", "problem", F.explode(F.array(parts)).alias("parts"))
    problem = F.when(F.col("problem").isNull() & F.col("parts").isNull(), "no JSON array").otherwise(F.col("problem"))
    rows = read.select("path", "title", problem.alias("problem"), F.posexplode_outer("parts").alias("place", "part"))
    fact = F.when(F.col("part").startswith("{"), F.from_json("part", "map<string,string>"))
    rows = rows.withColumn("fact", fact).where("fact is not null or problem is not null")
    shown = {n: F.when(F.col("fact").isNotNull(), F.when(F.map_contains_key("fact", n), F.coalesce(F.col("fact")[n], F.lit("None"))).otherwise("")) for n in _FACT_FIELDS}
    named = rows.select("path", "title", "place", "problem", "fact", *[c.alias(n) for n, c in shown.items()])
    return named.select(
        F.when(F.col("fact").isNotNull(), X.fact_id(F.col("path"), F.col("place"), F.col("key"))).alias("fact_id"),
        "path", "title", *_FACT_FIELDS, "place", "problem",
    )


# Fixed value: the offline fact pattern, "key: value".
COLON_FACT = r"(?md)^([A-Za-z][\w ]{0,40}): ([^\n]{1,120})$"


def extract_facts(notes: DataFrame, pattern: str = COLON_FACT) -> DataFrame:
    """Offline fact extraction: ``(fact_id, path, title, entity, key, value, context, place)``.

    Each match of a two-group pattern gives a fact about the note: group 1 is the key, group 2 the value.
    """
    zipped = F.arrays_zip(*[X.all_matches(F.col("body"), pattern, g).alias(n) for g, n in ((0, "context"), (1, "key"), (2, "value"))])
    rows = notes.select("path", "title", F.posexplode(zipped).alias("place", "m"))
    fields: list[Column] = [
        X.fact_id(F.col("path"), F.col("place"), F.col("m.key")).alias("fact_id"), F.col("path"), F.col("title"), F.col("title").alias("entity"),
        F.col("m.key").alias("key"), X.strip(F.col("m.value")).alias("value"), F.col("m.context").alias("context"), F.col("place"),
    ]
    return rows.select(*fields)
