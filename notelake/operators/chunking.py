"""Notes to chunks: frontmatter, sections, paragraphs, and packed sentences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.tokens import TokenCounter

HEADER_LINE = r"(?mdU)(?=^#{1,6}\s+.+$)"
_SECTION = "struct<header:string,text:string>"


def sections(body: Column) -> Column:
    """Array of ``(header, text)``: text before the first header when not blank, then one a header."""
    parts = F.split(body, HEADER_LINE, -1)

    def one(p: Column) -> Column:
        head = F.regexp_extract(p, r"(?dU)\A#{1,6}\s+(.+)", 1)
        rest = F.regexp_replace(p, r"(?dU)\A#{1,6}\s+.+", "")
        return F.struct(X.strip(head).alias("header"), X.strip(rest).alias("text"))

    is_head = lambda p: p.rlike(r"(?dU)\A#{1,6}\s+.")
    split = F.transform(parts, lambda p: F.when(is_head(p), one(p)).otherwise(F.struct(F.lit("").alias("header"), X.strip(p).alias("text"))))
    alone = F.array(F.struct(F.lit("").alias("header"), body.alias("text")))
    return F.when(F.size(X.all_matches(body, X.HEADER, 0)) == 0, alone).otherwise(split)


def paragraphs(text: Column) -> Column:
    parts = F.transform(F.split(text, r"(?U)\n\s*\n", -1), X.strip)
    return F.filter(parts, lambda p: p != "")


def sentences(text: Column) -> Column:
    parts = F.transform(F.split(text, X.SENTENCE_END, -1), X.strip)
    return F.filter(parts, lambda p: p != "")


def pack_sentences(text: Column, max_tokens: int, tokens=X.token_estimate) -> Column:
    """Sentences packed greedily while a batch has at most ``max_tokens``; joined without separator."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("now"))

    def step(a: Column, s: Column) -> Column:
        longer = F.concat(a["now"], s)
        full = (tokens(longer) > max_tokens) & (a["now"] != "")
        return F.when(full, F.struct(F.concat(a["done"], F.array(a["now"])).alias("done"), s.alias("now"))).otherwise(
            F.struct(a["done"].alias("done"), longer.alias("now"))
        )

    end = lambda a: F.when(X.strip(a["now"]) != "", F.concat(a["done"], F.array(a["now"]))).otherwise(a["done"])
    return F.aggregate(sentences(text), start, step, end)


def frontmatter_text(title: Column, fm: Column) -> Column:
    """``Note: title``, then one line a property."""
    shown = F.transform(
        fm,
        lambda e: F.concat(F.lit("  "), e["k"], F.lit(": "), F.when(e["v"]["type"] == "list", F.array_join(e["v"]["items"], ", ")).otherwise(e["v"]["str"])),
    )
    return F.array_join(F.concat(F.array(F.concat(F.lit("Note: "), title), F.lit("Properties:")), shown), "\n")


def counted_pieces(notes: DataFrame, max_tokens: int, counter: TokenCounter) -> DataFrame:
    """``notes(sections, ...)`` with ``pieces``: ``(kind, header, text)`` of sections that fit, else of paragraphs, else of packed sentences.

    A tokenizer counts and packs arrays of each note's texts, those alone that it must see: sections, paragraphs
    of long sections, sentences of long paragraphs. Each count sits in a column of its own behind a one-row generator, so
    that it stays out of the expressions that read it.
    """
    fixed = lambda df, name, c: df.withColumn(f"_{name}", c).select("*", F.explode(F.array(f"_{name}")).alias(name)).drop(f"_{name}")
    piece = lambda kind, header, text: F.struct(F.lit(kind).alias("kind"), header.alias("header"), text.alias("text"))

    def of_section(s: Column, n: Column) -> Column:
        return F.when(n <= max_tokens, F.array(piece("section", s["header"], s["text"]))).otherwise(
            F.transform(paragraphs(s["text"]), lambda p: piece("paragraph", s["header"], p))
        )

    def of_paragraph(p: Column, batches: Column) -> Column:
        return F.when(batches.isNull(), F.array(p)).otherwise(F.transform(batches, lambda b: piece("paragraph", p["header"], b)))

    filled = notes.withColumn("sections", F.filter("sections", lambda s: X.strip(s["text"]) != ""))
    sized = fixed(filled, "n", counter.counts(F.transform("sections", lambda s: s["text"])))
    cut = fixed(sized, "cut", F.flatten(F.zip_with("sections", "n", of_section))).drop("n")
    paragraph = lambda p, n: F.when((p["kind"] == "paragraph") & n, p["text"])
    sized = fixed(cut, "n", counter.counts(F.transform("cut", lambda p: paragraph(p, F.lit(True)))))
    long = F.zip_with("cut", "n", lambda p, n: paragraph(p, n > max_tokens))
    packed = fixed(sized, "batches", counter.packed(long, max_tokens))
    return packed.withColumn("pieces", F.flatten(F.zip_with("cut", "batches", of_paragraph))).drop("n", "cut", "batches")


def chunks(notes: DataFrame, max_tokens: int = 1500, tokens=X.token_estimate, counter: TokenCounter | None = None) -> DataFrame:
    """Chunks of parsed notes, one row each.

    Everything happens inside each note's own row (arrays, then one explode), so no shuffle is
    needed for the running chunk index. ``tokens`` is a Column function that counts tokens; a ``counter`` counts them
    with a tokenizer instead.
    """
    piece = lambda kind, header, text, shown, links: F.struct(
        F.lit(kind).alias("chunk_type"), header.alias("section_header"), text.alias("text"), shown.alias("content"), links.alias("links")
    )

    def prefixed(header: Column, text: Column) -> Column:
        section = F.when(header != "", F.concat(F.lit("Section: "), header, F.lit("\n"))).otherwise(F.lit(""))
        return F.concat(F.lit("Note: "), F.col("title"), F.lit("\n"), section, text)

    def cut(kind: str, header: Column, text: Column) -> Column:
        return piece(kind, header, text, prefixed(header, text), X.wikilinks(text))

    def by_paragraph(header: Column, p: Column) -> Column:
        whole = F.array(cut("paragraph", header, p))
        packed = F.transform(pack_sentences(p, max_tokens, tokens), lambda b: cut("paragraph", header, b))
        return F.when(tokens(p) <= max_tokens, whole).otherwise(packed)

    def by_section(s: Column) -> Column:
        header, text = s["header"], s["text"]
        split = F.flatten(F.transform(paragraphs(text), lambda p: by_paragraph(header, p)))
        return F.when(tokens(text) <= max_tokens, F.array(cut("section", header, text))).otherwise(split)

    front = frontmatter_text(F.col("title"), F.col("fm"))
    first = F.when(F.size("fm") > 0, F.array(piece("frontmatter", F.lit(""), front, front, F.array().cast("array<string>"))))
    filled = F.filter(F.col("sections"), lambda s: X.strip(s["text"]) != "")
    rest = F.flatten(F.transform(filled, by_section))
    cut_notes = notes.withColumn("sections", sections(F.col("body")))
    if counter is not None:
        cut_notes = counted_pieces(cut_notes, max_tokens, counter)
        whole = lambda p: piece("", p["header"], p["text"], prefixed(p["header"], p["text"]), X.wikilinks(p["text"])).withField("chunk_type", p["kind"])
        rest = F.transform("pieces", whole)
    every = F.when(F.size("fm") > 0, F.concat(first, rest)).otherwise(rest)
    rows = cut_notes.select("path", "title", "tags", F.posexplode(every).alias("chunk_index", "c"))
    return rows.select(
        X.chunk_id(F.col("path"), F.col("chunk_index")).alias("chunk_id"),
        F.col("path").alias("source_path"),
        F.col("title").alias("note_title"),
        F.col("c.section_header").alias("section_header"),
        F.col("c.chunk_type").alias("chunk_type"),
        "chunk_index",
        "tags",
        F.col("c.links").alias("links"),
        F.col("c.content").alias("content"),
        X.content_hash(F.col("c.text")).alias("content_hash"),
    )
