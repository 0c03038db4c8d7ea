"""Repair of conversations: cheapest edits that give a legal order of roles, by A* on the edit lattice."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, small_batches

WHITE = "\t\n\x0b\x0c\r "
DELETE, INSERT, REROLE, CUT_OFF = 4, 3, 3, 3
#: Rows are solved by blocks of this many (a power of two) in the order of all conversations.
BLOCK_BITS = 12

# Roles written so far: none, only a system row, ending in a user's, ending in an assistant's.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
AFTER_USER, AFTER_ASSISTANT = (NOTHING, SYSTEM, ASSISTANT), (USER,)
LEGAL = (NOTHING, ASSISTANT)


def damaged(conversations: DataFrame) -> DataFrame:
    """``(conv_id, turn, role, text)`` with faults put in by a checksum of ``conv_id:turn``; null texts and roles are one space."""
    c = conversations
    role, text = (F.coalesce(c[n].cast("string"), F.lit(" ")) for n in ("role", "text"))
    key = F.concat_ws(":", *(F.coalesce(c[n].cast("string"), F.lit(" ")) for n in ("conv_id", "turn")))
    rows = c.select(c["conv_id"].alias("conv_id"), c["turn"].cast("long").alias("turn"), role.alias("role"), text.alias("text"), F.pmod(F.crc32(key), F.lit(20)).alias("k"))
    k = F.col("k")
    hurt = F.when(k == 1, "").when(k == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.when(k == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    kept = rows.where(k != 0).select("conv_id", "turn", F.when(k == 4, "user").otherwise(F.col("role")).alias("role"), hurt.alias("text"), F.explode(copies).alias("copy"))
    return kept.drop("copy")


def moves(code: str, state: int) -> Iterator[tuple[str, int, int]]:
    """Edits that consume a row, as ``(initial, cost, state after)``.

    Codes are the row's role initial (``o`` for another), upper case when its text is cut off, or ``b`` and ``d`` for a
    blank and a repeated row, which only a deletion removes.
    """
    yield "D", DELETE, state
    if code in "bd":
        return
    role, charge = code.lower(), CUT_OFF if code.isupper() else 0
    if role == "s" and state == NOTHING:
        yield "K", charge, SYSTEM
    for initial, before, after in (("u", AFTER_USER, USER), ("a", AFTER_ASSISTANT, ASSISTANT)):
        if state in before:
            if role == initial:
                yield "K", charge, after
            yield "R", REROLE + charge, after


def cheapest(codes: str, entry: int = NOTHING, exits: tuple[int, ...] = LEGAL, every: bool = False) -> dict[int, tuple[int, str]]:
    """``{exit state: (cost, audit)}`` of the cheapest edits of a run of rows, of equal ones the least audit.

    A* over (rows consumed, state): what lies ahead costs at least a deletion for each blank or repeated row and a
    charge (or a dearer deletion) for each one cut off. The queue is keyed by cost with that bound, then by the audit; two
    audits of one place and cost never begin one another, as inserts cost, so the first to arrive is the least. It
    stops at the first of ``exits``, or goes on to every one.
    """
    ahead = [0] * (len(codes) + 1)
    for i in range(len(codes) - 1, -1, -1):
        ahead[i] = ahead[i + 1] + (DELETE if codes[i] in "bd" else CUT_OFF if codes[i].isupper() else 0)
    queue, done, found = [(ahead[0], "", 0, entry)], set(), {}
    while queue:
        bound, audit, i, state = heappop(queue)
        if (i, state) in done:
            continue
        done.add((i, state))
        cost = bound - ahead[i]
        if i == len(codes):
            if state in exits:
                found[state] = (cost, audit)
                if not every:
                    return found
        else:
            for edit, more, after in moves(codes[i], state):
                if (i + 1, after) not in done:
                    heappush(queue, (cost + more + ahead[i + 1], audit + edit, i + 1, after))
        after = ASSISTANT if state == USER else USER
        if (i, after) not in done:
            heappush(queue, (cost + INSERT + ahead[i], audit + "I", i, after))
    return found


def written(codes: str, audit: str, entry: int) -> list[str]:
    """What each row becomes: its inserts before it (``U``, ``A``), then ``k`` kept, ``u`` or ``a`` rerole, ``d`` deleted; trailing inserts end the last one's."""
    out, now, i, state = [], "", 0, entry
    for edit in audit:
        if edit == "D":
            out, now, i = [*out, now + "d"], "", i + 1
        elif edit == "K" and codes[i].lower() == "s":
            out, now, i, state = [*out, now + "k"], "", i + 1, SYSTEM
        else:
            state = ASSISTANT if state == USER else USER
            name = "a" if state == ASSISTANT else "u"
            if edit == "I":
                now += name.upper()
            else:
                out, now, i = [*out, now + ("k" if edit == "K" else name)], "", i + 1
    out[-1] += now
    return out


_SOLVED = "conv string, block long, cost long, audit string, written array<string>"
_RUNS = "conv string, block long, codes string, entry int, leave int, cost long, audit string"


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Conversations that lie in one block."""
    for batch in batches:
        convs, blocks, codes = (c.to_pylist() for c in batch.columns)
        best = [min(cheapest(c).values()) for c in codes]
        cols = [pa.array(convs, pa.string()), pa.array(blocks, pa.int64()), pa.array([b[0] for b in best], pa.int64()), pa.array([b[1] for b in best], pa.string())]
        plans = pa.array([written(c, b[1], NOTHING) for c, b in zip(codes, best, strict=True)], pa.list_(pa.string()))
        yield pa.RecordBatch.from_arrays([*cols, plans], names=["conv", "block", "cost", "audit", "written"])


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parts of conversations: the cheapest edits from every state to every state."""
    names = ["conv", "block", "codes", "entry", "leave", "cost", "audit"]
    for batch in batches:
        for conv, block, codes in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            rows = [
                dict(zip(names, (conv, block, codes, entry, leave, cost, audit), strict=True))
                for entry in range(4) for leave, (cost, audit) in cheapest(codes, entry, tuple(range(4)), True).items()
            ]
            yield pa.RecordBatch.from_pylist(rows, pa.schema([(n, pa.string() if n in ("conv", "codes", "audit") else pa.int32() if n in ("entry", "leave") else pa.int64()) for n in names]))


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Conversations of several blocks: the cheapest chain of their parts, of equal ones the least audit.

    Between parts every state keeps its best chain; as above, equal dear audits of one place never begin one another, so
    the best chain's parts are best chains.
    """
    for batch in batches:
        for conv, parts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            blocks = sorted({p["block"] for p in parts})
            by_block = {b: [p for p in parts if p["block"] == b] for b in blocks}
            best: dict[int, tuple] = {NOTHING: (0, "", ())}
            for b in blocks:
                grown: dict[int, tuple] = {}
                for p in by_block[b]:
                    if p["entry"] in best:
                        cost, audit, chain = best[p["entry"]]
                        new = (cost + p["cost"], audit + p["audit"], (chain, p))
                        if p["leave"] not in grown or new[:2] < grown[p["leave"]][:2]:
                            grown[p["leave"]] = new
                best = grown
            _, _, chain = min((best[s] for s in LEGAL if s in best), key=lambda x: x[:2])
            rows = []
            while chain:
                chain, p = chain
                rows.append({"conv": conv, "block": p["block"], "cost": p["cost"], "audit": p["audit"], "written": written(p["codes"], p["audit"], p["entry"])})
            fields = [("conv", pa.string()), ("block", pa.int64()), ("cost", pa.int64()), ("audit", pa.string()), ("written", pa.list_(pa.string()))]
            yield pa.RecordBatch.from_pylist(rows, pa.schema(fields))


def _ordered(rows: DataFrame, name: str) -> DataFrame:
    """Rows with their place ``o`` in the order of conversation, turn (nulls first) and content, and what the repair needs of each.

    Ranges of that order are dealt out, so that a long conversation lies in several tasks.
    """
    text, role = F.col("text"), F.col("role")
    said = F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)
    bare = F.btrim(text, F.lit(WHITE))
    code = F.when(F.left(role, F.lit(1)).isin("s", "u", "a"), F.left(role, F.lit(1))).otherwise("o")
    code = F.when(bare == "", "b").when(F.right(bare, F.lit(1)).isin(".", "!", "?"), code).otherwise(F.upper(code))
    keyed = rows.withColumn("conv", F.coalesce(F.col("conv_id").cast("string"), F.lit(""))).withColumns({"said": said, "code": code, "initial": F.left(role, F.lit(1))})
    keys = [F.col("conv"), F.col("turn").asc_nulls_first(), F.col("said")]
    dealt = keyed.repartitionByRange(*keys).sortWithinPartitions(*keys)
    return materialize(dealt.select("conv", "conv_id", "turn", "role", "text", "said", "code", "initial", F.monotonically_increasing_id().alias("o")), name)


def _pieces(rows: DataFrame, block_bits: int) -> DataFrame:
    """One row for each conversation and block: its codes, counts and edges."""
    repeats = rows.groupBy("conv", "said").agg(F.min("o").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    code = F.when((F.col("code") != "b") & (F.col("o") > F.col("first")), "d").otherwise(F.col("code"))
    marked = rows.select("conv", "said", "turn", "code", "initial", "o").join(repeats, ["conv", "said"], "left").withColumn("code", code)
    block = F.shiftright("o", block_bits)
    row = F.struct("o", "turn", "code", "initial")
    grouped = marked.groupBy("conv", block.alias("block")).agg(F.array_sort(F.collect_list(row)).alias("r"))
    each = lambda name: F.transform("r", lambda x: x[name])
    count = lambda test: F.size(F.filter(F.col("r"), test)).cast("long")
    turns = F.array_distinct(F.array_compact(each("turn")))
    return materialize(
        grouped.select(
            "conv", "block", F.array_join(each("code"), "").alias("codes"), F.get("r", F.lit(0))["o"].alias("o"),
            count(lambda x: x["code"] == "b").alias("blank"), count(lambda x: x["code"] == "d").alias("duplicate"),
            count(lambda x: x["code"].isin("S", "U", "A", "O")).alias("truncated"), _illegal(each("initial")).alias("illegal"),
            each("initial")[0].alias("first"), F.element_at(each("initial"), -1).alias("last"),
            F.array_min(turns).alias("low"), F.array_max(turns).alias("high"), F.size(turns).cast("long").alias("turns"),
        ),
        "conversation_blocks",
    )


def _illegal(initials: Column) -> Column:
    """How many neighbours are not system and user, user and assistant, or assistant and user."""
    pairs = F.zip_with(F.slice(initials, F.lit(1), F.size(initials) - 1), F.slice(initials, F.lit(2), F.size(initials) - 1), lambda a, b: F.concat(a, b))
    return F.size(F.filter(pairs, lambda p: ~p.isin("su", "ua", "au"))).cast("long")


def _per_conversation(pieces: DataFrame, solved: DataFrame) -> DataFrame:
    """``(conv, gaps, blank, duplicate, truncated, illegal, cost, audit)`` from the blocks of each conversation, in their order."""
    part = F.struct("block", "first", "last", "low", "high", "audit")
    total = ["blank", "duplicate", "truncated", "illegal", "cost", "turns"]
    rows = pieces.join(solved.select("conv", "block", "cost", "audit"), ["conv", "block"])
    grouped = rows.groupBy("conv").agg(*[F.sum(c).alias(c) for c in total], F.min("low").alias("low"), F.max("high").alias("high"), F.array_sort(F.collect_list(part)).alias("p"))
    n = F.size("p") - 1
    edges = F.zip_with(F.slice("p", F.lit(1), n), F.slice("p", F.lit(2), n), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    crossing = F.size(F.filter(edges, lambda e: ~F.concat(e["a"]["last"], e["b"]["first"]).isin("su", "ua", "au")))
    shared = F.size(F.filter(edges, lambda e: e["a"]["high"] == e["b"]["low"]))
    gaps = F.coalesce(F.col("high") - F.col("low") + 1 - F.col("turns") + shared, F.lit(0))
    audit = F.array_join(F.transform("p", lambda x: x["audit"]), "")
    return grouped.select("conv", gaps.cast("long").alias("gaps"), "blank", "duplicate", "truncated", (F.col("illegal") + crossing).cast("long").alias("illegal"), "cost", audit.alias("audit"))


def repair(rows: DataFrame, block_bits: int = BLOCK_BITS) -> tuple[DataFrame, DataFrame]:
    """Repaired rows and a report of ``rows(conv_id, turn, role, text)``.

    Report: ``(conv, gaps, blank, duplicate, truncated, illegal, cost, audit)`` by conversation, whose key ``conv`` is the conv_id as
    text ('' for null). Repaired rows: ``(conv, o, k, edit, role, text)`` in the order of ``o, k``; ``edit`` is ``k`` kept, ``u``/``a`` rerole,
    ``U``/``A`` inserted.

    A conversation's rows go by turn, nulls first, rows of one turn by their content. Blocks of 2**block_bits rows of all conversations
    are solved apart: A* over each conversation that lies in one block; of a longer one, from every state to every state of each part, and then
    the cheapest chain of parts. So no task holds more than a block's rows, and of a long conversation its audit. Null roles and texts
    should be replaced first (``damaged`` does); null conv_ids are one conversation; empty texts are blank;
    an empty table gives empty results; other columns are ignored.
    """
    small_batches(rows.sparkSession)
    ordered = _ordered(rows.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text"), "conversations")
    pieces = _pieces(ordered, block_bits)
    long = pieces.groupBy("conv").agg(F.count("*").alias("n")).where("n > 1").select("conv")
    codes = pieces.select("conv", "block", "codes")
    whole = codes.join(long, "conv", "left_anti").mapInArrow(_whole, _SOLVED)
    runs = codes.join(long, "conv", "left_semi").repartition("conv", "block").mapInArrow(_runs, _RUNS)
    chains = runs.groupBy("conv").agg(F.collect_list(F.struct("block", "codes", "entry", "leave", "cost", "audit")).alias("parts")).mapInArrow(_joined, _SOLVED)
    solved = materialize(whole.union(chains), "conversation_edits")
    plan = solved.join(pieces.select("conv", "block", F.col("o").alias("start")), ["conv", "block"]).select("conv", "block", "start", "written")
    each = plan.select("conv", "start", F.posexplode("written").alias("i", "does")).select("conv", (F.col("start") + F.col("i")).alias("o"), "does")
    edits = ordered.select("conv", "o", "role", "text").join(each, ["conv", "o"])
    edits = edits.select("conv", "o", "role", "text", F.posexplode(F.split("does", "")).alias("k", "edit")).where(F.col("edit").isin("k", "u", "a", "U", "A"))
    low = F.lower("edit")
    repaired = edits.select(
        "conv", "o", "k", "edit",
        F.when(low == "u", "user").when(low == "a", "assistant").otherwise(F.col("role")).alias("role"),
        F.when(F.col("edit").isin("U", "A"), "").otherwise(F.col("text")).alias("text"),
    )
    return repaired, _per_conversation(pieces, solved)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines sorted by conversation, as they stream by: a hash of each one's, newline-joined."""
    now, digest = None, hashlib.sha256()
    for batch in batches:
        convs, out = [], []
        for conv, line in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if conv != now:
                if now is not None:
                    convs.append(now)
                    out.append(digest.hexdigest())
                now, digest = conv, hashlib.sha256(line.encode())
            else:
                digest.update(b"\n" + line.encode())
        yield pa.RecordBatch.from_arrays([pa.array(convs, pa.string()), pa.array(out, pa.string())], names=["conv", "sha"])
    if now is not None:
        yield pa.RecordBatch.from_arrays([pa.array([now]), pa.array([digest.hexdigest()])], names=["conv", "sha"])


def audited(conversations: DataFrame) -> DataFrame:
    """``conversations`` damaged and repaired: a row for each original conv_id with its report and a hash of the repaired rows.

    One hash over a conversation's text is made in one task, which reads its sorted lines as a stream and holds none. A conversation that
    lost all rows has zeros, an empty audit and the hash of nothing.
    """
    repaired, report = repair(damaged(conversations))
    line = F.concat("role", F.lit(":"), "text")
    lines = repaired.select("conv", line.alias("line"), "o", "k").repartition("conv").sortWithinPartitions("conv", "o", "k")
    hashes = lines.select("conv", "line").mapInArrow(_hashed, "conv string, sha string")
    ids = conversations.select("conv_id").distinct().withColumn("conv", F.coalesce(F.col("conv_id").cast("string"), F.lit("")))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    rows = ids.join(report, "conv", "left").join(hashes, "conv", "left")
    return rows.select(
        "conv_id", *[zero(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
        F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"),
    )
