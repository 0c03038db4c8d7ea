"""Mixing sources to target weights by temperature, as budgeted block permutations (DataFrame functions only)."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, text_of

#: Most sources whose totals (one row each) the driver reads to bisect the exponent.
MAX_SOURCES = 100_000
#: Rows of a block, on average.
BLOCK_ROWS = 512
#: Epochs of a block that one row stands for until they are dealt out; most epochs that a source may have.
EPOCHS, MOST_EPOCHS = 1_000, (1 << 31) - 2
#: The exponent is a multiple of 1 / STEPS in [0, 1].
STEPS = 1_000_000
WORD = r"[^\x20\x09-\x0D]+"


@dataclass(frozen=True)
class Mixture:
    """Exponent, its normaliser and the token budget of all sources together."""

    exponent: float
    normaliser: float
    budget: float

    def weight(self, tokens: Column) -> Column:
        return F.pow(tokens.cast("double"), F.lit(self.exponent)) / F.lit(self.normaliser)


def solve(
    totals: list[int], entropy: float | None = None, repetition: float | None = None, budget: float | None = None, cover: bool = False
) -> Mixture:
    """Bisect the exponent in [0, 1] for token totals of the sources.

    With ``entropy`` (bits): the largest exponent whose weights have at least that entropy. With
    ``repetition``: the smallest exponent at which no source is repeated more than that many
    times within the budget. ``cover`` sets the budget so that every source is used whole at
    least once; else it is ``budget``, by default the sum of the totals. Exponent 1 keeps the
    sources' own shares, 0 makes them equal. Without a solution the exponent is the nearest end.
    """
    totals = [t for t in totals if t > 0]
    if not totals:
        return Mixture(1.0, 1.0, 0.0)

    def at(k: int) -> tuple[list[float], float, float]:
        powers = [math.pow(t, k / STEPS) for t in totals]
        z = math.fsum(powers)
        size = max(t * z / p for t, p in zip(totals, powers, strict=True)) if cover else float(budget or sum(totals))
        return [p / z for p in powers], z, size

    def fits(k: int) -> bool:
        weights, _, size = at(k)
        if entropy is not None:
            return -math.fsum(w * math.log2(w) for w in weights) < entropy
        return max(w * size / t for w, t in zip(weights, totals, strict=True)) <= repetition

    low, high = 0, STEPS  # fits() is false below some k and true from it on
    if entropy is None and repetition is None:
        low = high
    while low < high:
        mid = (low + high) // 2
        if fits(mid):
            high = mid
        else:
            low = mid + 1
    if entropy is not None and high and fits(high):
        high -= 1
    _, z, size = at(high)
    return Mixture(high / STEPS, z, size)


def token_counts(docs: DataFrame, source_col: str = "source") -> DataFrame:
    """``(doc_id, source, tokens, h)``: words between ASCII white space; a null source counts as ''."""
    return docs.select(
        docs["doc_id"].cast("long").alias("doc_id"),
        F.coalesce(docs[source_col].cast("string"), F.lit("")).alias("source"),
        F.regexp_count(text_of(docs), F.lit(WORD)).cast("long").alias("tokens"),
    )


def _digest(*parts: Column) -> Column:
    return F.sha2(F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts]), 256)


def mix(
    docs: DataFrame,
    seed: int = 0,
    entropy: float | None = None,
    repetition: float | None = 2.0,
    budget: float | None = None,
    cover: bool = False,
    source_col: str = "source",
) -> DataFrame:
    """``(doc_id, source, tokens, epoch, block, block_rank)``, one row a use of a document.

    Source weights are token shares to the power of a bisected exponent (see ``solve``), made to
    sum to one; a source's budget is its weight times the whole budget. A source is cut into
    blocks by a hash of seed and doc_id, about BLOCK_ROWS rows each; in every epoch its blocks
    follow a keyed permutation (``block_rank`` from 1). Whole epochs take every document; the
    last, partial one takes documents in the order of block rank and hash until the budget
    is used: those that start before it ends. Rows that repeat a doc_id are used side by
    side; a null text has no tokens and, like an empty one, is used with its block; a null
    doc_id hashes as "null"; a null source is the source ''. An empty table gives no rows.
    """
    counted = materialize(token_counts(docs, source_col), "tokens")
    totals = materialize(counted.groupBy("source").agg(F.sum("tokens").alias("total"), F.count("*").alias("n")), "totals")
    known = totals.select("total").limit(MAX_SOURCES + 1).collect()
    if len(known) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources; group them first")
    found = solve([r["total"] for r in known], entropy, repetition, budget, cover)

    share = F.when(F.col("total") > 0, F.floor(found.weight(F.col("total")) * F.lit(found.budget)).cast("long")).otherwise(0)
    if cover:  # the largest source's share is its total but for rounding
        share = F.greatest(share, F.col("total"))
    whole = F.when(F.col("total") > 0, F.floor(share / F.greatest(F.col("total"), F.lit(1))).cast("long")).otherwise(F.lit(1).cast("long"))
    whole = F.when(whole > MOST_EPOCHS, F.raise_error(F.concat(F.lit("too many epochs of the source "), "source")).cast("long")).otherwise(whole)
    plan = totals.select(
        "source", F.ceil(F.col("n") / BLOCK_ROWS).cast("long").alias("blocks"), whole.alias("whole"), (share - whole * F.col("total")).alias("rest")
    )
    h = _digest(F.lit(seed), F.col("doc_id"))
    number = F.conv(F.substring("h", 1, 8), 16, 10).cast("long")
    placed = (
        counted.withColumn("h", h)
        .join(F.broadcast(plan.select("source", "blocks")), "source")
        .select("doc_id", "source", "tokens", F.substring("h", 9, 56).alias("h"), F.pmod(number, F.col("blocks")).alias("block"))
    )
    inside = Window.partitionBy("source", "block").orderBy("h", "doc_id", "tokens").rowsBetween(Window.unboundedPreceding, -1)
    ordered = materialize(placed.withColumn("before", F.coalesce(F.sum("tokens").over(inside), F.lit(0).cast("long"))).drop("h"), "placed")

    blocks = ordered.groupBy("source", "block").agg(F.sum("tokens").alias("size"))
    # A small source may have very many epochs: they are dealt out in parts.
    parts = F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("whole") / EPOCHS))).alias("part")
    dealt = blocks.join(F.broadcast(plan), "source").select("source", "block", "size", "whole", "rest", parts).repartition("source", "block", "part")
    within = F.sequence(F.col("part") * EPOCHS + 1, F.least((F.col("part") + 1) * EPOCHS, F.col("whole") + 1))
    epochs = dealt.select("source", "block", "size", "whole", "rest", F.explode(within.cast("array<int>")).alias("epoch"))
    turn = _digest(F.lit(seed), F.col("epoch"), F.col("source"), F.col("block"))
    # A source's blocks are ranked in two levels: within ranges of the turn's hash, then over the 256 ranges.
    turned = materialize(epochs.withColumn("turn", turn).withColumn("range", F.substring("turn", 1, 2)), "turns")
    among = Window.partitionBy("source", "epoch").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = turned.groupBy("source", "epoch", "range").agg(F.count("*").alias("n"), F.sum("size").alias("total"))
    ahead = ranges.select(
        "source", "epoch", "range", F.coalesce(F.sum("n").over(among), F.lit(0)).alias("n_ahead"), F.coalesce(F.sum("total").over(among), F.lit(0)).alias("ahead")
    )
    run = Window.partitionBy("source", "epoch", "range").orderBy("turn", "block")
    ranked = (
        turned.withColumn("own_rank", F.row_number().over(run))
        .withColumn("own_done", F.sum("size").over(run) - F.col("size"))
        .join(ahead, ["source", "epoch", "range"])
        .withColumn("block_rank", (F.col("own_rank") + F.col("n_ahead")).cast("int"))
        .withColumn("done", F.col("own_done") + F.col("ahead"))
        .withColumn("room", F.when(F.col("epoch") <= F.col("whole"), F.lit((1 << 63) - 1)).otherwise(F.col("rest") - F.col("done")))
        .where("room > 0")
        .select("source", "block", "epoch", "block_rank", "room")
    )
    schedule = materialize(ranked, "schedule")
    used = ordered.join(schedule, ["source", "block"]).where("before < room")
    return used.select("doc_id", "source", "tokens", "epoch", "block", "block_rank")


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs``, each as often as ``mix`` uses its doc_id, with the columns of ``docs``.

    Rows that repeat a doc_id, or have none, are each used as often as any of them; a null or empty text is used like another,
    null sources are one source; an empty table gives no rows.
    """
    uses = mix(docs, **options).groupBy("doc_id").agg(F.max("epoch").alias("copies"))
    times = materialize(uses.select(F.col("doc_id").alias("used_id"), "copies"), "uses")
    row = F.struct(*[docs[c] for c in docs.columns]).alias("row")
    joined = docs.select(docs["doc_id"].cast("long").alias("own_id"), row).join(times.hint("merge"), F.col("own_id").eqNullSafe(F.col("used_id")))
    return joined.select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("epoch")).select("row.*")
