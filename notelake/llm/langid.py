"""Language identification by cross-parsing entropy with suffix automata."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import ArrowUDFType

from .common import hash_sample, released, small_batches
from .inttable import IntTable

#: Bounded training sample: documents a language, and characters a language in all.
SAMPLE_DOCS = 400
SAMPLE_CHARS = 60_000
#: Characters over all languages together; many languages share it.
SAMPLE_TOTAL = 600_000
#: Texts are parsed in blocks of this many symbols, each begun with a new phrase.
BLOCK = 1024
#: Symbols parsed side by side at once.
BATCH_SYMBOLS = 1_000_000
#: Entries (4 bytes each) of the direct table of a model's commonest symbols; a hash table has the others.
DIRECT = 1 << 24
UNKNOWN = "und"
#: Score under which ``keep_identified`` rejects a text.
LEAST_SCORE = 0.5


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """1 at every code point that is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), np.int32, 0x110000)


class Symbols:
    """Maps lower-cased letters to integers: 0 for all that is no letter, 1 for a letter that no
    sample has, and from 2 on every letter of the samples, whatever its script, the commonest first."""

    def __init__(self, texts: list[str]):
        seen, n = np.unique(np.concatenate([_codes(t) for t in texts]) if texts else np.empty(0, np.uint32), return_counts=True)
        letter = _letters()[seen] > 0
        self.seen = seen[letter][np.argsort(-n[letter], kind="stable")]
        self.size = len(self.seen) + 2
        self._table = None

    def __getstate__(self) -> dict:
        return {**self.__dict__, "_table": None}

    def encode(self, text: str) -> np.ndarray:
        if self._table is None:
            self._table = _letters().copy()
            self._table[self.seen] = np.arange(2, self.size)
        out = self._table[_codes(text)]
        keep = np.ones(len(out), bool)
        keep[1:] = (out[1:] != 0) | (out[:-1] != 0)
        return out[keep]


def _automaton(symbols: list[int]) -> list[dict[int, int]]:
    """Suffix automaton: transitions of every state; state 0 is the root."""
    moves: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in symbols:
        new = len(moves)
        moves.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in moves[p]:
            moves[p][c] = new
            p = link[p]
        if p >= 0:
            q = moves[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                copy = len(moves)
                moves.append(dict(moves[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                link[q] = link[new] = copy
                while p >= 0 and moves[p].get(c) == q:
                    moves[p][c] = copy
                    p = link[p]
        last = new
    return moves


class Model:
    """The suffix automata of ``{language: texts}``, their states numbered through.

    ``keys`` holds ``state * symbols + symbol`` of every transition that goes on with a phrase,
    ``to`` its next state; ``starts`` holds the state after a phrase's first symbol by language
    (its root where the language lacks the symbol). A model travels as these arrays; the hash
    tables over them are made where it is used.
    """

    def __init__(self, samples: dict[str, list[str]]):
        self.langs = sorted(samples)
        self.symbols = Symbols([t for k in self.langs for t in samples[k]])
        width, n = self.symbols.size, 0
        self.cost, self.roots, keys, to = [], [], [np.empty(0, np.int64)], [np.empty(0, np.int32)]
        self.starts = np.zeros((len(self.langs), width), np.int32)
        for j, k in enumerate(self.langs):
            joined = self.symbols.encode(" ".join(samples[k]))
            moves = _automaton(joined.tolist())
            self.cost.append(float(np.log2(len(joined) + 2)))
            self.roots.append(n)
            self.starts[j] = n
            for c, t in moves[0].items():
                self.starts[j, c] = n + t
            state = np.repeat(np.arange(n + 1, n + len(moves), dtype=np.int64), [len(m) for m in moves[1:]])
            keys.append(state * width + np.fromiter((c for m in moves[1:] for c in m), np.int64, len(state)))
            to.append(np.fromiter((t + n for m in moves[1:] for t in m.values()), np.int32, len(state)))
            n += len(moves)
        self.keys, self.to = np.concatenate(keys), np.append(np.concatenate(to), np.int32(-1))
        self.states, self._tables = n, None

    def __getstate__(self) -> dict:
        return {**self.__dict__, "_tables": None}

    def _next(self) -> tuple[np.ndarray, int, IntTable, np.ndarray]:
        """A direct table of all states and the first symbols, its width, and a hash table of the rest."""
        if self._tables is None:
            width = max(2, min(self.symbols.size, DIRECT // max(1, self.states)))
            state, c = np.divmod(self.keys, self.symbols.size)
            direct = np.full(self.states * width, -1, np.int32)
            near = c < width
            direct[state[near] * width + c[near]] = self.to[:-1][near]
            self._tables = direct, width, IntTable(self.keys[~near]), np.append(self.to[:-1][~near], np.int32(-1))
        return self._tables

    def phrases(self, texts: list[np.ndarray]) -> np.ndarray:
        """Phrases of the greedy parse of each text by each language: ``(texts, languages)``."""
        direct, near, table, far_to = self._next()
        owner, parts = [], []
        for i, t in enumerate(texts):
            for at in range(0, len(t), BLOCK):
                owner.append(i)
                parts.append(t[at : at + BLOCK])
        out = np.zeros((len(texts), len(self.langs)), np.int64)
        if not parts:
            return out
        size = np.array([len(p) for p in parts])
        order = np.argsort(-size, kind="stable")
        grid = np.zeros((int(size.max()), len(parts)), np.int32 if self.symbols.size > 255 else np.uint8)
        for j, k in enumerate(order):
            grid[: size[k], j] = parts[k]
        active = np.searchsorted(-size[order], -np.arange(len(grid)), side="left")
        who = np.array(owner)[order]
        rare = (grid >= near).any(axis=1) if near < self.symbols.size else np.zeros(len(grid), bool)
        for j, root in enumerate(self.roots):
            state, found = np.full(len(parts), root, np.int32), np.zeros(len(parts), np.int64)
            for step, n in enumerate(active):
                c = grid[step, :n]
                if rare[step]:
                    to = direct.take(state[:n] * near + np.minimum(c, near - 1))
                    k = np.flatnonzero(c >= near)
                    to[k] = far_to[table.find(state[k].astype(np.int64) * self.symbols.size + c[k])]
                else:
                    to = direct.take(state[:n] * near + c)
                new = to < 0
                found[:n] += new
                state[:n] = np.where(new, self.starts[j].take(c), to)
            np.add.at(out[:, j], who, found)
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Language needing fewest normalised phrases, and its share of the likelihood."""
        coded = [self.symbols.encode(t or "") for t in texts]
        size = np.array([max(1, len(c)) for c in coded])
        if not self.langs:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        rate = np.zeros((len(texts), len(self.langs)))
        at = 0
        while at < len(coded):
            end, total = at, 0
            while end < len(coded) and (end == at or total + len(coded[end]) <= BATCH_SYMBOLS):
                total += len(coded[end])
                end += 1
            rate[at:end] = self.phrases(coded[at:end]) * np.array(self.cost) / size[at:end, None]
            at = end
        best = rate.argmin(axis=1)
        gap = rate - rate.min(axis=1, keepdims=True)
        score = 1 / np.exp(-gap * np.minimum(size, 64)[:, None] / 2).sum(axis=1)
        letter = np.array([bool(c.any()) for c in coded], bool)
        names = [self.langs[b] if ok else UNKNOWN for b, ok in zip(best, letter, strict=True)]
        return names, np.where(letter, score, 0.0)


def fold(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(modulus))


def training_sample(labelled: DataFrame) -> tuple[tuple[str, tuple[str, ...]], ...]:
    """A bounded sample of ``labelled(doc_id, text, lang)``: pieces of SAMPLE_DOCS documents a language.

    Documents are taken in the order of a hash of their id, pieces from a hash-chosen place.
    """
    ids = labelled.where("lang is not null and doc_id is not null").select("doc_id", "lang", F.xxhash64("doc_id", F.lit(7)).alias("h"))
    kept = hash_sample(ids, "lang", SAMPLE_DOCS).distinct()
    n = max(1, kept.select("lang").distinct().count())
    piece = max(20, min(SAMPLE_CHARS, SAMPLE_TOTAL // n) // SAMPLE_DOCS)
    room = F.greatest(F.lit(1), F.length("text") - piece)
    cut = F.substring(F.col("text"), (F.lit(1) + F.pmod(F.col("h"), room)).cast("int"), F.lit(piece * 2))
    texts = labelled.where("text is not null").join(F.broadcast(kept), ["doc_id", "lang"]).select("lang", "h", "doc_id", cut.alias("t"))
    got: dict[str, list[tuple[int, int, str]]] = {}
    for row in texts.collect():
        got.setdefault(row["lang"], []).append((row["h"], row["doc_id"], row["t"]))
    out = []
    for lang in sorted(got):
        picked, room_left = [], min(SAMPLE_CHARS, SAMPLE_TOTAL // n)
        for _, _, t in sorted(got[lang]):
            if room_left > 0 and t:
                picked.append(t[:room_left])
                room_left -= len(t)
        if picked:
            out.append((lang, tuple(picked)))
    return tuple(out)


def _predictor(docs: DataFrame, folds: int, held: int):
    """A function of text giving ``struct<lang_pred, score>``, learned from rows outside the held-out fold.

    Only texts travel to the Python workers, and only names and scores come back.
    """
    small_batches(docs.sparkSession)
    learned = docs.where(F.coalesce(fold(docs["doc_id"], folds) != held, F.lit(False)))
    picked = training_sample(learned.select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")))
    model = docs.sparkSession.sparkContext.broadcast(Model({k: list(v) for k, v in picked}))

    def predicted(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from released(parts(batches))

    def parts(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known = model.value
        for texts in batches:
            names, scores, at = [], [], 0
            while at < len(texts):
                end, total, part = at, 0, []
                while end < len(texts) and (end == at or total <= BATCH_SYMBOLS):
                    part.append(texts[end].as_py())
                    total += len(part[-1] or "")
                    end += 1
                name, score = known.predict(part)
                names += name
                scores.append(score)
                at = end
            score = pa.array(np.concatenate(scores) if scores else np.empty(0))
            yield pa.StructArray.from_arrays([pa.array(names, pa.string()), score], names=["lang_pred", "score"])

    # Not to be evaluated once for a filter and again for what it keeps.
    return F.arrow_udf(predicted, "lang_pred string, score double", ArrowUDFType.SCALAR_ITER).asNondeterministic()


def identify(docs: DataFrame, folds: int = 4, held: int = 2) -> DataFrame:
    """``(doc_id, held_out, lang_pred, score)`` of every row of ``docs(doc_id, text, lang)``.

    Learns from rows with a language outside the held-out fold; each language's labelled text
    becomes a suffix automaton, a text is parsed greedily into longest matches by each, and the
    language with the lowest ``phrases * log2(training length) / length`` wins (ties: the
    first by name). Whole texts are read, block by block. ``und`` with score 0 for a null text,
    a text without a letter, or when nothing could be learned. Repeated rows give repeated
    rows, a null doc_id counts as held out, other columns are ignored.
    """
    held_out = F.coalesce(fold(docs["doc_id"], folds) == held, F.lit(True))
    predicted = _predictor(docs, folds, held)
    rows = docs.select("doc_id", held_out.alias("held_out"), predicted(docs["text"].cast("string")).alias("p"))
    return rows.select("doc_id", "held_out", "p.lang_pred", "p.score")


def keep_identified(docs: DataFrame, least: float = LEAST_SCORE, folds: int = 4, held: int = 2) -> DataFrame:
    """The rows of ``docs`` whose language ``identify`` names with a score of ``least`` or more.

    All columns stay, and ``lang`` becomes the predicted language. Rows with null, empty or
    letterless texts go (they are ``und``), and so do texts that fit several languages alike. Repeated rows
    are judged alike, a null doc_id doesn't matter, an empty table gives an empty result.
    """
    predicted = _predictor(docs, folds, held)
    row = F.struct(*[docs[c] for c in docs.columns]).alias("row")
    named = docs.select(row, predicted(docs["text"].cast("string")).alias("p"))
    kept = named.where((F.col("p.lang_pred") != UNKNOWN) & (F.col("p.score") >= least))
    kind = docs.schema["lang"].dataType
    return kept.select(*[F.col("p.lang_pred").cast(kind).alias(c) if c == "lang" else F.col("row")[c].alias(c) for c in docs.columns])
