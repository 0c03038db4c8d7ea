"""Deletion of repeated runs of lines by winnowing over line hashes (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize, text_of

#: Lines of a run that is found whatever its length: the winnowing window.
MIN_RUN = 3
#: Words of a shorter run that is found too.
MIN_WORDS = 50
WORD = r"[^\x20\x09-\x0D]+"


def _starts(run: int, least: int, n: int):
    """Where windows of ``n`` lines start: everywhere for whole runs, else where the lines have ``least`` words."""
    size = F.size("ids")
    every = F.when(size >= n, F.sequence(F.lit(0), size - n)).otherwise(F.array().cast("array<int>"))
    words = lambda s: sum((F.get("words", s + i) for i in range(1, n)), F.get("words", s))
    return every if n == run else F.filter(every, lambda s: words(s) >= least)


def _selected(s, n: int):
    """The least line hash of a window, and its line (leftmost of equals)."""
    part = F.slice(F.col("first"), s + 1, n)
    low = F.array_min(part)
    return F.struct(low.alias("f"), (s + F.array_position(part, low) - 1).cast("int").alias("p"))


def _first():
    """Hashes of lines, from which windows select."""
    return F.transform("ids", lambda x: F.xxhash64(x))


def fingerprints(lines: DataFrame, run: int, least: int) -> DataFrame:
    """``(f, d, k, p)``: of ``lines(d, k, ids, words)``, each place that some window selects, once."""
    of = lambda n: F.transform(_starts(run, least, n), lambda s: _selected(s, n))
    picked = F.flatten(F.array(*[of(n) for n in range(1, run + 1)]))
    rows = lines.select("d", "k", "ids", "words", F.explode(F.array(_first())).alias("first"))
    return rows.select("d", "k", F.explode(F.array_distinct(picked)).alias("x")).select("x.f", "d", "k", "x.p")


def extended(lines: DataFrame, hits: DataFrame, run: int, least: int) -> DataFrame:
    """``(d, k, s, n, w)``: from each place of ``hits(d, k, places)``, both ways, the windows that selected it, with their lines' digest."""
    rows = lines.join(hits, ["d", "k"]).select("d", "k", "ids", "words", "places", F.explode(F.array(_first())).alias("first"))

    def around(n):
        held = F.filter(_starts(run, least, n), lambda s: F.array_contains("places", _selected(s, n)["p"]))
        own = lambda s: F.sha2(F.to_binary(F.array_join(F.transform(F.slice("ids", s + 1, n), F.hex), ""), F.lit("hex")), 256)
        return F.transform(held, lambda s: F.struct(s.alias("s"), F.lit(n).alias("n"), F.unhex(F.left(own(s), F.lit(32))).alias("w")))

    windows = F.flatten(F.array(*[around(n) for n in range(1, run + 1)]))
    return rows.select("d", "k", F.explode(windows).alias("x")).select("d", "k", "x.s", "x.n", "x.w")


def repeated_lines(docs: DataFrame, min_run: int = MIN_RUN, min_words: int = MIN_WORDS) -> DataFrame:
    """``(doc_id, text_key, lines)``: of each text, the lines (from 0) that belong to a run of ``min_run`` or more
    lines, or of fewer with ``min_words`` or more words, which occurs earlier, in the order of
    doc_id, text hash and line."""
    rows = docs.select(F.coalesce(docs["doc_id"].cast("long"), F.lit(-(1 << 63))).alias("d"), text_of(docs).alias("t"))
    cut = F.split(F.col("t"), "\n")
    ids = F.transform(cut, lambda x: F.unhex(F.left(F.sha2(x, 256), F.lit(32))))
    words = F.transform(cut, lambda x: F.regexp_count(x, F.lit(WORD)))
    lines = materialize(rows.select("d", F.xxhash64("t").alias("k"), ids.alias("ids"), words.alias("words")), "lines")
    # A run that occurs twice has its selected places twice: join the places by their hash.
    prints = materialize(fingerprints(lines, min_run, min_words), "fingerprints")
    place = F.struct("d", "k", "p")
    shared = materialize(prints.groupBy("f").agg(F.min(place).alias("lo"), F.max(place).alias("hi")).where("lo <> hi").select("f"), "shared")
    hits = prints.join(shared, "f").groupBy("d", "k").agg(F.collect_set("p").alias("places"))
    near = materialize(extended(lines, hits, min_run, min_words), "extended")
    discard(lines, prints, shared)
    at = F.struct("d", "k", "s")
    origin = materialize(near.groupBy("w", "n").agg(F.min(at).alias("lo"), F.max(at).alias("hi")).where("lo <> hi").select("w", "n", "lo"), "origins")
    later = near.join(origin, ["w", "n"]).where(F.struct("d", "k", "s") > F.col("lo"))
    covered = later.select("d", "k", F.explode(F.sequence(F.col("s"), F.col("s") + F.col("n") - 1)).alias("line"))
    found = materialize(covered.groupBy(F.col("d").alias("doc_id"), F.col("k").alias("text_key")).agg(F.collect_set("line").alias("lines")), "repeated")
    discard(near, origin)
    return found


def dedup_lines(docs: DataFrame, min_run: int = MIN_RUN, min_words: int = MIN_WORDS) -> DataFrame:
    """``(doc_id, n_lines, n_removed, text)`` of every row, later repeated runs deleted.

    Lines end at ``\\n``. A window of ``min_run`` lines, or of fewer with ``min_words`` words together, selects its
    least line hash; runs of at least that many lines or words that occur twice therefore share a selected place. Selected places alone
    are written and joined by their hash; those that have it in common are extended both ways to the windows that
    selected them, whose lines are compared by 128 bits of SHA-256, and every line of a window that occurs earlier (by doc_id, text hash, line)
    is deleted; the first occurrence stays. Shorter texts stay whole; null counts as
    empty; rows that repeat a doc_id with equal text count as one place and all keep what it
    keeps; a null doc_id sorts first; other columns are ignored; an empty table gives none.
    """
    found = repeated_lines(docs, min_run, min_words)
    per_doc = found.select(F.col("doc_id").alias("d"), F.col("text_key").alias("k"), F.col("lines").alias("gone"))
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_of(docs).alias("t")).select(
        "doc_id", "t", F.coalesce("doc_id", F.lit(-(1 << 63))).alias("d"), F.xxhash64("t").alias("k")
    )
    lines = F.split(F.col("t"), "\n")
    rest = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("gone"))
    kept = F.array_join(F.transform(rest, lambda i: F.get(lines, i)), "\n")
    return rows.join(per_doc.hint("merge"), ["d", "k"], "left").select(
        "doc_id",
        F.size(lines).cast("long").alias("n_lines"),
        F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).cast("long").alias("n_removed"),
        F.when(F.col("gone").isNull(), F.col("t")).otherwise(kept).alias("text"),
    )
