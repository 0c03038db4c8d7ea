"""Set-based changes to notes, with a journal and undo."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X

KEEP_OPERATIONS = 50


def create(notes: DataFrame, new: DataFrame) -> DataFrame:
    """``notes(path, content)`` with the rows of ``new`` whose path is free."""
    return notes.select("path", "content").unionByName(new.join(notes.select("path"), "path", "left_anti").select("path", "content"))


def delete(notes: DataFrame, paths: DataFrame) -> DataFrame:
    return notes.join(paths.select("path"), "path", "left_anti")


def render(fm: dict, content: str) -> str:
    """A note's text with a YAML header, when there are properties."""
    import yaml

    return f"---\n{yaml.safe_dump(fm, sort_keys=False, allow_unicode=True).rstrip()}\n---\n\n{content}" if fm else content


def append(content: Column, more: Column) -> Column:
    """Content and more on a line of its own; an empty note gets the separator too."""
    return F.concat(content, F.when(content.endswith("\n"), F.lit("")).otherwise(F.lit("\n")), more)


def _with_newline(c: Column) -> Column:
    return F.when(c.endswith("\n"), c).otherwise(F.concat(c, F.lit("\n")))


def patch(notes: DataFrame, ops: DataFrame) -> DataFrame:
    """Apply ``ops(path, op_ord, action, line, content)`` to ``notes(path, content)``; all notes are returned.

    Line numbers mean the text before the batch; operations run from the last line to the first,
    equal lines in their own order. An insert goes before its line, past the end it appends, and
    at line 0 or less it counts from the end as a list index does; deletes and replacements out
    of range do nothing; another action raises. The operations of a note fold over its lines.
    """
    step = F.struct((-F.col("line")).alias("back"), "op_ord", "action", "line", "content")
    grouped = ops.groupBy("path").agg(F.array_sort(F.collect_list(step)).alias("ops"))
    lines = F.split(F.col("content"), r"(?<=\n)", -1)
    lines = F.filter(lines, lambda x: x != "")

    def apply(a: Column, o: Column) -> Column:
        n, at = F.size(a), o["line"] - 1
        put = F.when(at < 0, F.greatest(F.lit(0), n + at)).otherwise(F.least(at, n))
        head = lambda k: F.slice(a, F.lit(1), k)
        tail = lambda k: F.slice(a, k + 1, F.greatest(F.lit(0), n - k))
        new = F.array(_with_newline(o["content"]))
        inside = (at >= 0) & (at < n)
        return (
            F.when(o["action"] == "insert", F.concat(head(put), new, tail(put)))
            .when((o["action"] == "delete") & inside, F.concat(head(at), tail(at + 1)))
            .when((o["action"] == "replace") & inside, F.concat(head(at), new, tail(at + 1)))
            .when(o["action"].isin("delete", "replace"), a)
            .otherwise(F.raise_error(F.concat(F.lit("Unknown patch action: "), o["action"])).cast("array<string>"))
        )

    folded = F.array_join(F.aggregate(F.col("ops"), lines, apply), "")
    return notes.join(grouped, "path", "left").select("path", F.when(F.col("ops").isNull(), F.col("content")).otherwise(folded).alias("content"))


def update_properties(fm: Column, updates: dict[str, str | None]) -> Column:
    """Entries with ``updates`` set in place or added; a None value removes its key."""
    gone = [k for k, v in updates.items() if v is None]
    given = {k: v for k, v in updates.items() if v is not None}
    text = lambda v: F.struct(F.lit("str").alias("type"), F.lit(v).alias("str"), F.lit(None).cast("array<string>").alias("items"))
    kept = F.filter(fm, lambda e: ~e["k"].isin(gone)) if gone else fm

    def changed(e: Column) -> Column:
        value = e["v"]
        for k, v in given.items():
            value = F.when(e["k"] == k, text(v)).otherwise(value)
        return F.struct(e["k"].alias("k"), value.alias("v"))

    kept = F.transform(kept, changed) if given else kept
    for k, v in given.items():
        fresh = F.array(F.struct(F.lit(k).alias("k"), text(v).alias("v")))
        kept = F.when(F.array_contains(F.transform(fm, lambda e: e["k"]), k), kept).otherwise(F.concat(kept, fresh))
    return kept


def header_text(fm: Column) -> Column:
    """Entries as a YAML header block; strings that would read back as something else are quoted."""

    def shown(v: Column) -> Column:
        text = v["str"]
        odd = text.rlike(r"""\A[\s\[\]{}'"&*!|>%@`,?:#-]|\A\z|[:\s]\z|:\s|\s#""") | (X.typed(text)["type"] != "str")
        quoted = F.concat(F.lit("'"), F.replace(text, F.lit("'"), F.lit("''")), F.lit("'"))
        plain = F.when((v["type"] == "str") & odd, quoted).otherwise(text)
        items = F.array_join(F.transform(v["items"], lambda i: F.concat(F.lit("'"), F.replace(i, F.lit("'"), F.lit("''")), F.lit("'"))), ", ")
        listed = F.when(v["type"] == "list", F.concat(F.lit("["), F.when(X.plain_items(v["items"]), F.array_join(v["items"], ", ")).otherwise(items), F.lit("]")))
        return F.when(v["type"] == "NoneType", F.lit("null")).when(v["type"] == "list", listed).otherwise(plain)

    lines = F.transform(fm, lambda e: F.concat(e["k"], F.lit(": "), shown(e["v"]), F.lit("\n")))
    return F.concat(F.lit("---\n"), F.array_join(lines, ""), F.lit("---\n"))


def retained(journal: DataFrame, keep: int = KEEP_OPERATIONS) -> DataFrame:
    """The last ``keep`` operations of ``journal(seq, ...)``."""
    return journal.orderBy(F.desc("seq")).limit(keep)


def last_message(journal: DataFrame) -> DataFrame:
    """Operations of the trailing run of one message id."""
    last = journal.agg(F.max_by("message_id", "seq").alias("last_id"))
    before = journal.crossJoin(F.broadcast(last)).where("message_id <> last_id").agg(F.max("seq").alias("edge"))
    return journal.crossJoin(F.broadcast(before)).where("edge is null or seq > edge").drop("edge")


def restored(journal: DataFrame) -> DataFrame:
    """``(path, content)``: the state that taking back the last message gives each of its paths; null removes the note."""
    run = last_message(journal)
    back = run.groupBy("path").agg(F.min_by(F.struct("before_content"), "seq").alias("b"))
    return back.select("path", F.col("b.before_content").alias("content"))


def undo(notes: DataFrame, journal: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Notes and journal with the last message's operations taken back.

    Each path gets the state before its first operation in the run; none (null) removes it.
    """
    back = restored(journal)
    rest = notes.select("path", "content").join(back.select("path"), "path", "left_anti")
    return rest.unionByName(back.where("content is not null")), journal.join(last_message(journal).select("seq"), "seq", "left_anti")
