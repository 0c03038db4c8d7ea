"""Token counts by a tokenizer's vocabulary file, for chunks that must fit a model exactly."""

from __future__ import annotations

import base64
import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: how byte-level tokenizers cut a text before they merge.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SENTENCE_END = re.compile(r"(?<=[.!?])\s+")
_LOADED: dict[tuple, object] = {}


@dataclass(frozen=True)
class TokenCounter:
    """Counts by a file of ranks (a token in base64 and its rank a line), which the tasks read from ``path`` or hold as ``ranks``.

    Each Python worker loads it once. ``read`` takes the file to the tasks, where they don't share a folder with the driver.
    """

    path: str
    pattern: str = PATTERN
    ranks: bytes | None = None

    @classmethod
    def read(cls, path: str, pattern: str = PATTERN) -> TokenCounter:
        with open(path, "rb") as f:
            return cls(path, pattern, f.read())

    def _encoding(self):
        key = (self.path, self.pattern)
        if key not in _LOADED:
            import tiktoken

            raw = self.ranks
            if raw is None:
                with open(self.path, "rb") as f:
                    raw = f.read()
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, raw.splitlines())}
            _LOADED[key] = tiktoken.Encoding(self.path, pat_str=self.pattern, mergeable_ranks=ranks, special_tokens={})
        return _LOADED[key]

    def count(self, text: str) -> int:
        return len(self._encoding().encode_ordinary(text))

    def pack(self, text: str, most: int) -> list[str]:
        """Sentences packed greedily while a batch has at most ``most`` tokens; joined without separator."""
        out, now = [], ""
        for sentence in filter(None, (s.strip() for s in SENTENCE_END.split(text))):
            if now and self.count(now + sentence) > most:
                out.append(now)
                now = ""
            now += sentence
        return [*out, now] if now else out

    def counts(self, texts: Column) -> Column:
        """Tokens of each text of an array, null for null."""

        def each(rows: pa.Array) -> pa.Array:
            return pa.array([None if r is None else [None if t is None else self.count(t) for t in r] for r in rows.to_pylist()], pa.list_(pa.int32()))

        return F.arrow_udf(each, "array<int>")(texts)

    def packed(self, texts: Column, most: int) -> Column:
        """``pack`` of each text of an array, null for null."""

        def each(rows: pa.Array) -> pa.Array:
            kind = pa.list_(pa.list_(pa.string()))
            return pa.array([None if r is None else [None if t is None else self.pack(t, most) for t in r] for r in rows.to_pylist()], kind)

        return F.arrow_udf(each, "array<array<string>>")(texts)
