"""SentencePiece BPE encoding with seeded merge dropout, and lossless decoding."""

from __future__ import annotations

import heapq
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import released, small_batches
from .inttable import IntTable

SPACE = "▁"
DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Symbols of the longest chunk that is merged side by side with others, grid widths, and chunks of a grid.
SHORT = 40
WIDTHS = (4, 6, 8, 10, 12, 16, 24, SHORT)
ROWS = 16_384
#: Characters of the texts that are encoded together.
BATCH_CHARS = 300_000
_M = (1 << 64) - 1
_FAR, _WIDE = np.iinfo(np.int32).max, 64
_AT, _STOP = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F


def _place(at: int, stop: int) -> int:
    return (at * _AT + stop * _STOP) & _M


def _draw(key: int, place: int) -> int:
    """Keyed 64-bit hash of a candidate merge's place."""
    h = ((key ^ place) * 0xFF51AFD7ED558CCD) & _M
    return (((h ^ (h >> 33)) * 0xC4CEB9FE1A85EC53) & _M) ^ (h >> 40)


def _draws(keys: np.ndarray, places: np.ndarray) -> np.ndarray:
    """``_draw`` of many."""
    h = (keys ^ places) * np.uint64(0xFF51AFD7ED558CCD)
    return ((h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)) ^ (h >> np.uint64(40))


def chunk_keys(key: int, n: int) -> np.ndarray:
    """Keys of the ``n`` chunks of a text whose own key is ``key``."""
    x = np.uint64(key) + np.arange(1, n + 1, dtype=np.uint64) * np.uint64(_AT)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_key(seed: int, doc_id, use: int, text: str) -> int:
    """Key of one use of a document's text."""
    return xxhash.xxh64_intdigest(f"{doc_id}:{use}:".encode() + text.encode(), seed)


class Pieces:
    """A SentencePiece BPE vocabulary with byte fallback."""

    def __init__(self, model: bytes):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.texts = [sp.id_to_piece(i) for i in range(sp.vocab_size())]
        special = [sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) for i in range(len(self.texts))]
        self.byte_ids = {int(t[3:5], 16): i for i, t in enumerate(self.texts) if sp.is_byte(i)}
        if len(self.byte_ids) < 256:
            raise ValueError("the vocabulary has no piece for every byte, so texts would not decode losslessly")
        normal = [i for i in range(len(self.texts)) if not special[i] and not sp.is_byte(i)]
        self.ids = {self.texts[i]: i for i in normal}
        self.scores = {self.texts[i]: sp.get_score(i) for i in normal}
        self.bytes = [b""] * len(self.texts)
        for i in normal:
            self.bytes[i] = self.texts[i].replace(SPACE, " ").encode()
        for b, i in self.byte_ids.items():
            self.bytes[i] = bytes([b])
        joins = [t for t in self.ids if len(t) > 1]
        self.cut_at_space = not any(SPACE in t.lstrip(SPACE) for t in joins)
        self.cut_at_line = not any("\n" in t for t in joins)
        self._pairs = None
        self.char_ids = np.full(0x10000, -1, np.int32)
        for t, i in self.ids.items():
            if len(t) == 1 and ord(t) < 0xFFFF:
                self.char_ids[ord(t)] = i

    def chunk_starts(self, codes: np.ndarray, literal: np.ndarray, begin: np.ndarray) -> np.ndarray:
        """Where a chunk starts that no merge crosses: at a text's begin, about a literal U+2581, and
        as far as no piece crosses them, where a run of spaces begins and about a line's end."""
        out = begin | literal
        out[1:] |= literal[:-1]
        if self.cut_at_space:
            space = codes == ord(SPACE)
            out[1:] |= space[1:] & ~space[:-1]
        if self.cut_at_line:
            line = codes == 10
            out |= line
            out[1:] |= line[:-1]
        return out

    def merge(self, chunk: str, dropout: float, key: int) -> array:
        """Ids of one chunk: the agenda of merges, best score first, then leftmost.

        A candidate popped from the agenda is skipped when the keyed hash of its place and
        width falls under ``dropout``; it may come back only as part of another pair.
        """
        n = len(chunk)
        scores, limit = self.scores, int(dropout * 2.0**64)
        end = list(range(1, n + 1))  # of the symbol that starts here; 0 once merged away
        before = list(range(-1, n - 1))
        agenda: list[tuple[float, int, int, int]] = []
        for i in range(n - 1):
            s = scores.get(chunk[i : i + 2])
            if s is not None:
                agenda.append((-s, i, i + 1, i + 2))
        heapq.heapify(agenda)
        while agenda:
            _, a, b, stop = heapq.heappop(agenda)
            if end[a] != b or end[b] != stop:
                continue
            if limit and _draw(key, _place(a, stop)) < limit:
                continue
            end[a], end[b] = stop, 0
            if stop < n:
                before[stop] = a
                s = scores.get(chunk[a : end[stop]])
                if s is not None:
                    heapq.heappush(agenda, (-s, a, stop, end[stop]))
            p = before[a]
            if p >= 0:
                s = scores.get(chunk[p:stop])
                if s is not None:
                    heapq.heappush(agenda, (-s, p, a, stop))
        out, i = [], 0
        while i < n:
            out.append(chunk[i : end[i]])
            i = end[i]
        return self._ids(out)

    def _ids(self, symbols: list[str]) -> array:
        out = array("i")
        for piece in symbols:
            known = self.ids.get(piece)
            if known is None:
                out.extend([self.byte_ids[x] for x in piece.encode()])
            else:
                out.append(known)
        return out

    def pair_table(self) -> tuple[IntTable, np.ndarray, np.ndarray]:
        """All merges by ``left id * vocabulary + right id``: a table, and each row's piece and agenda rank."""
        if self._pairs is None:
            size, order = len(self.texts), sorted(set(self.scores.values()), reverse=True)
            rank = {c: r for r, c in enumerate(order)}
            rows = [
                (self.ids[t[:k]] * size + self.ids[t[k:]], i, rank[self.scores[t]])
                for t, i in self.ids.items()
                for k in range(1, len(t))
                if t[:k] in self.ids and t[k:] in self.ids
            ]
            keys, piece, ranks = np.array(rows, np.int64).reshape(-1, 3).T
            self._pairs = IntTable(keys), np.append(piece, -1).astype(np.int32), np.append(ranks * _WIDE, _FAR).astype(np.int32)
        return self._pairs

    def merge_grid(self, symbols: np.ndarray, size: np.ndarray, limit: int, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``merge`` of many chunks side by side: their ids one after the other, and how many each has.

        ``symbols[i, k]`` is the id of chunk k's i-th character, -1 beyond its ``size``. In
        every step each chunk pops its agenda's first candidate; symbols are linked lists.
        """
        table, piece, ranks = self.pair_table()
        width, n = symbols.shape
        vocabulary = np.int64(len(self.texts))

        def find(x: np.ndarray, y: np.ndarray) -> np.ndarray:
            return table.find(np.where((x < 0) | (y < 0), np.int64(-2), x * vocabulary + y))

        alive = (symbols >= 0).ravel()
        flat = np.append(symbols.astype(np.int32).ravel(), np.int32(-1))  # the last stands for beyond the end
        after = np.repeat(np.arange(1, width + 1, dtype=np.int32)[:, None], n, axis=1).ravel()
        after = np.where(after >= np.tile(size, width), np.int32(width), after)
        before = np.repeat(np.arange(-1, width - 1, dtype=np.int32)[:, None], n, axis=1).ravel()
        row = np.full(width * n, table.none, np.int32)
        row[: (width - 1) * n] = find(flat[: (width - 1) * n], flat[n : width * n])
        mine = np.arange(n)
        agenda = (ranks[row] + np.repeat(np.arange(width, dtype=np.int32), n) * (ranks[row] != _FAR)).reshape(width, n)
        while len(mine):
            best = agenda.min(axis=0)
            live = best != _FAR
            if live.sum() < 0.75 * len(live) or not live.any():
                mine, agenda, best, live = mine[live], np.ascontiguousarray(agenda[:, live]), best[live], live[live]
                if not len(mine):
                    break
            col = np.flatnonzero(live)
            a, k = best[col] % _WIDE, mine[col]
            at = a * n + k
            b = after[at]
            stop = after[b * n + k]
            agenda[a, col] = _FAR
            if limit:
                place = a.astype(np.uint64) * np.uint64(_AT) + np.minimum(stop, size[k]).astype(np.uint64) * np.uint64(_STOP)
                go = _draws(keys[k], place) >= np.uint64(limit)
                col, a, k, at, b, stop = (x[go] for x in (col, a, k, at, b, stop))
            agenda[b, col] = _FAR
            alive[b * n + k] = False
            flat[at] = own = piece[row[at]]
            after[at] = stop
            inner = stop < width
            before[(stop * n + k)[inner]] = a[inner]
            right = np.where(inner, stop * n + k, width * n)
            found = find(own, flat[right])
            row[at] = found
            agenda[a, col] = ranks[found] + a * (ranks[found] != _FAR)
            p = before[at]
            some = p >= 0
            p, col, k = p[some], col[some], k[some]
            found = find(flat[p * n + k], own[some])
            row[p * n + k] = found
            agenda[p, col] = ranks[found] + p * (ranks[found] != _FAR)
        alive = alive.reshape(width, n)
        return flat[:-1].reshape(width, n).T[alive.T], alive.sum(axis=0)


def _spread(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Places ``first[k] .. first[k] + size[k]`` of all k, one after the other."""
    done = np.cumsum(size) - size
    return np.repeat(first - done, size) + np.arange(int(size.sum()))


class Encoder:
    """Encodes texts; every occurrence of a chunk has its own draws, so nothing is remembered."""

    def __init__(self, model: bytes, dropout: float, seed: int):
        self.pieces, self.dropout, self.seed = Pieces(model), dropout, seed
        size = np.fromiter(map(len, self.pieces.bytes), np.int64, len(self.pieces.bytes))
        self.piece_size, self.piece_first = size, np.cumsum(size) - size
        self.piece_bytes = np.frombuffer(b"".join(self.pieces.bytes), np.uint8)
        self.literal = np.array([self.pieces.byte_ids[x] for x in SPACE.encode()], np.int32)

    def encode_many(self, texts: list[str], keys: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, and how many each has."""
        pieces = self.pieces
        length = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        codes = np.frombuffer("".join([" " + t for t in texts]).encode("utf-32-le", "surrogatepass"), np.uint32)
        begin = np.zeros(len(codes), bool)
        begin[np.cumsum(length) - length] = True
        literal = codes == ord(SPACE)
        codes = np.where(codes == 32, np.uint32(ord(SPACE)), codes)
        first = np.flatnonzero(pieces.chunk_starts(codes, literal, begin))
        size = np.diff(first, append=len(codes))
        owner = np.searchsorted(np.cumsum(length), first, side="right")
        counts = np.bincount(owner, minlength=len(texts))
        key = np.concatenate([np.empty(0, np.uint64), *(chunk_keys(k, n) for k, n in zip(keys, counts.tolist(), strict=True))])
        symbols = pieces.char_ids[np.minimum(codes, len(pieces.char_ids) - 1)]
        unknown = np.add.reduceat((symbols < 0).astype(np.int64), first) if len(first) else size
        got: list[np.ndarray] = [self.literal]
        n_ids, at, done = np.zeros(len(first), np.int64), np.zeros(len(first), np.int64), len(self.literal)
        n_ids[literal[first]] = len(self.literal)
        side = ~literal[first] & (unknown == 0) & (size <= SHORT)
        for k in np.flatnonzero(~side & ~literal[first]).tolist():
            chunk = codes[first[k] : first[k] + size[k]].tobytes().decode("utf-32-le", "surrogatepass")
            ids = pieces.merge(chunk, self.dropout, int(key[k]))
            got.append(np.frombuffer(ids, np.int32))
            n_ids[k], at[k], done = len(ids), done, done + len(ids)
        low = 0
        for width in WIDTHS:
            which = np.flatnonzero(side & (size > low) & (size <= width))
            low = width
            for part in np.array_split(which, -(-len(which) // ROWS) or 1):
                if len(part):
                    place = first[part] + np.arange(width)[:, None]
                    grid = np.where(np.arange(width)[:, None] < size[part], symbols[np.minimum(place, len(symbols) - 1)], np.int32(-1))
                    ids, n = pieces.merge_grid(grid, size[part], int(self.dropout * 2.0**64), key[part])
                    got.append(ids)
                    n_ids[part], at[part] = n, done + np.cumsum(n) - n
                    done += len(ids)
        ids = np.concatenate(got)[_spread(at, n_ids)]
        total = np.bincount(owner, n_ids, minlength=len(texts)).astype(np.int64)
        return ids, total

    def encode(self, text: str, key: int = 0) -> array:
        return array("i", self.encode_many([text], [key])[0].tobytes())

    def raw(self, ids: np.ndarray) -> np.ndarray:
        """The bytes that ``ids`` stand for."""
        return self.piece_bytes[_spread(self.piece_first[ids], self.piece_size[ids])]

    def lossless(self, texts: list[str], ids: np.ndarray, counts: np.ndarray) -> list[bool]:
        """Whether the ids of each text decode to it."""
        want = [(" " + t).encode() for t in texts]
        got, ends = self.raw(ids), np.cumsum(counts)
        size = np.concatenate(([0], np.cumsum(self.piece_size[ids])))
        size = size[ends] - size[ends - counts]
        out, at = [], 0
        for w, n in zip(want, size.tolist(), strict=True):
            out.append(n == len(w) and got[at : at + n].tobytes() == w)
            at += n
        return out

    def decode(self, ids) -> str:
        """The text of ``ids``, without the space that encoding puts first."""
        return self.raw(np.asarray(ids, np.int64)).tobytes().decode("utf-8", "replace")[1:]


_ENCODERS: dict[tuple, Encoder] = {}


def _encoder(model: bytes, dropout: float, seed: int) -> Encoder:
    key = (xxhash.xxh3_128_digest(model), dropout, seed)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(model, dropout, seed)
    return _ENCODERS[key]


def _runs(texts: pa.Array) -> Iterator[tuple[int, list[str | None]]]:
    """First row and texts of each part of a batch that is encoded together."""
    part, at, total = [], 0, 0
    for k in range(len(texts)):
        part.append(texts[k].as_py())
        total += len(part[-1] or "")
        if total > BATCH_CHARS:
            yield at, part
            part, at, total = [], k + 1, 0
    if part:
        yield at, part


def _encoded(batches, model, dropout: float, seed: int) -> Iterator[pa.RecordBatch]:
    enc = _encoder(model.value, dropout, seed)
    for batch in batches:
        for at, texts in _runs(batch.column(1)):
            owners, uses = batch.column(0).slice(at, len(texts)), batch.column(2).slice(at, len(texts)).to_pylist()
            keys = [text_key(seed, d, use, t or "") for d, use, t in zip(owners.to_pylist(), uses, texts, strict=True)]
            ids, counts = enc.encode_many([t or "" for t in texts], keys)
            fine = enc.lossless([t or "" for t in texts], ids, counts)
            none = np.array([t is None for t in texts])
            if none.any():
                ids, counts = ids[~np.repeat(none, counts)], np.where(none, 0, counts)
            offsets = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids))
            cols = [owners, pa.array(uses, pa.int32()), lists, pa.array(fine, pa.bool_())]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "use", "ids", "lossless"])


def _decoded(batches, model) -> Iterator[pa.RecordBatch]:
    enc = _encoder(model.value, 0.0, 0)
    for batch in batches:
        texts = [None if i is None else enc.decode(i) for i in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])


def _broadcast_model(df: DataFrame, path: str):
    with open(path, "rb") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


#: Copies of one row that a task makes; more are dealt out.
COPIES = 1_000


def _numbered(rows: DataFrame) -> DataFrame:
    """``rows(doc_id, text)`` with ``use``: equal rows are numbered from 0, so that the numbers depend on the rows alone.

    Where no row repeats another, rows stay where they lie. Otherwise equal rows are counted, before they move, and each
    is made again as often as it was there: it makes no difference which one gets which number.
    """
    keyed = rows.withColumns({"h1": F.xxhash64("text"), "h2": F.xxhash64(F.lit(1), "text")})
    counts = keyed.groupBy("doc_id", "h1", "h2").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    if counts <= 1:
        return rows.withColumn("use", F.lit(0))
    once = keyed.groupBy("doc_id", "h1", "h2").agg(F.any_value("text").alias("text"), F.count("*").alias("n"))
    if counts <= COPIES:
        return once.select("doc_id", "text", F.explode(F.sequence(F.lit(0), (F.col("n") - 1).cast("int"))).alias("use"))
    parts = F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / COPIES).cast("int"))).alias("part")
    dealt = once.select("doc_id", "h1", "n", "text", parts).repartition("doc_id", "h1", "part")
    last = F.least(F.col("n"), (F.col("part") + 1) * COPIES) - 1
    return dealt.select("doc_id", "text", F.explode(F.sequence((F.col("part") * COPIES).cast("int"), last.cast("int"))).alias("use"))


def encode(docs: DataFrame, model_path: str = DEFAULT_MODEL, dropout: float = 0.1, seed: int = 0, use: str | None = None) -> DataFrame:
    """``(doc_id, use, ids, lossless)`` of every row of ``docs(doc_id, text)``.

    A candidate merge is skipped by a hash keyed with seed, doc_id, text, use, the chunk's number in
    the text and the candidate's place, so that every occurrence of a word has its own draws and
    runs repeat exactly. ``use`` names a column that numbers the uses of a document (say, its epoch); without one, rows that are equal in
    doc_id and text are numbered from 0, wherever they lie. With ``dropout`` 0
    the ids are SentencePiece's own. ``lossless`` says whether decoding gives the text back.
    Characters without a piece, and a literal U+2581, become byte pieces. A null text gives no
    ids and counts as lossless, an empty one gives the piece of the leading space; the model file (bounded by its
    vocabulary) is read by the driver and broadcast; a null doc_id is keyed as None; other columns
    are ignored; an empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    model = _broadcast_model(docs, model_path)
    ids = docs.schema["doc_id"].dataType.simpleString()
    own = docs["doc_id"], docs["text"].cast("string").alias("text")
    rows = _numbered(docs.select(*own)) if use is None else docs.select(*own, docs[use].cast("int").alias("use"))
    rows = rows.select("doc_id", "text", F.col("use").cast("int").alias("use"))
    return rows.mapInArrow(lambda it: released(_encoded(it, model, dropout, seed)), f"doc_id {ids}, use int, ids array<int>, lossless boolean")


def decode(encoded: DataFrame, model_path: str = DEFAULT_MODEL) -> DataFrame:
    """``(doc_id, text)`` of ``encoded(doc_id, ids)``; null ids give a null text."""
    model = _broadcast_model(encoded, model_path)
    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", "ids").mapInArrow(lambda it: _decoded(it, model), f"doc_id {kind}, text string")
