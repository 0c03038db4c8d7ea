"""The text model of a note as Column expressions: frontmatter, tags, links, headers, hashes.

Patterns carry the flags that give Java's engine the meaning intended here: ``d`` so that only
``\\n`` ends a line, ``m`` for line anchors, ``U`` where white space means Unicode white space.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The patterns that define links, tags and headers.
WIKILINK = r"\[\[([^\]|]+)(?:\|[^\]]+)?\]\]"
TAG = r"(?mdU)#(?<!\S#)([a-zA-Z0-9_][a-zA-Z0-9_/\-]*)"
HEADER = r"(?mdU)^(#{1,6})\s+(.+)$"
BOUNDARY = r"(?mdU)\A-{3,}\s*?$"
FENCED = r"(?mdU)\A-{3,}\s*?$((?s:.*?))^-{3,}\s*?$"
ENTRY = r"(?md)^([^\s#:'\"\-\[\]{}][^:\n]*):(?:[ \t]+([^\n]*?)|)[ \t]*$((?:\n[ \t]*-[ \t]+[^\n]*)*)"
SENTENCE_END = r"(?U)(?<=[.!?])\s+"

#: Unicode's white space.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"

VALUE = "struct<type:string,str:string,items:array<string>>"
ENTRIES = f"array<struct<k:string,v:{VALUE}>>"


def strip(c: Column) -> Column:
    """Without leading and trailing white space of any kind; only the ends are looked at."""
    return F.btrim(c, F.lit(WHITE))


def unix_newlines(c: Column) -> Column:
    return F.regexp_replace(c, r"\r\n?", "\n")


def all_matches(c: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(group))


# -- paths


def name_of(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def stem(path: Column) -> Column:
    """File name without its last extension; a leading dot starts no extension."""
    return F.regexp_replace(name_of(path), r"(?<=.)\.[^.]*$", "")


def extension(path: Column) -> Column:
    return F.regexp_extract(name_of(path), r".(\.[^.]+)$", 1)


def folder(path: Column) -> Column:
    return F.when(F.instr(path, "/") > 0, F.regexp_replace(path, r"/[^/]*$", "")).otherwise(F.lit("."))


def hidden(path: Column) -> Column:
    """Whether any component of a relative path starts with a dot."""
    return path.rlike(r"(^|/)\.")


# -- frontmatter


def fence(content: Column) -> Column:
    """The frontmatter block with both its fences, '' without one; reads no further than the second fence."""
    whole = strip(content)
    return F.when(whole.startswith("---"), F.regexp_extract(whole, FENCED, 0)).otherwise(F.lit(""))


def split_note(content: Column, block: Column | None = None) -> tuple[Column, Column]:
    """Frontmatter text (null without one) and stripped body; ``block`` is the note's ``fence``, when at hand."""
    whole, block = strip(content), fence(content) if block is None else block
    front = F.when(block != "", F.regexp_extract(block, FENCED, 1))
    return front, strip(F.substring(whole, F.length(block) + 1, F.length(whole)))


def typed(raw: Column) -> Column:
    """A scalar's YAML type and the text Python's ``str`` gives it."""
    value = F.struct
    text = strip(raw)
    double = F.regexp_replace(text, "_", "").cast("double")
    no_items = F.lit(None).cast("array<string>").alias("items")
    of = lambda kind, s: value(F.lit(kind).alias("type"), s.cast("string").alias("str"), no_items)
    double_quoted = F.regexp_replace(F.regexp_extract(text, r'(?s)\A"(.*)"\z', 1), r'\\(["\\])', "$1")
    single_quoted = F.regexp_replace(F.regexp_extract(text, r"(?s)\A'(.*)'\z", 1), "''", "'")
    plain = strip(F.regexp_replace(text, r"\s#.*$", ""))
    return (
        F.when(text.rlike(r'\A".*"\z'), of("str", double_quoted))
        .when(text.rlike(r"\A'.*'\z"), of("str", single_quoted))
        .when(plain.rlike(r"\A(~|null|Null|NULL|)\z"), of("NoneType", F.lit("None")))
        .when(plain.rlike(r"\A(yes|Yes|YES|true|True|TRUE|on|On|ON)\z"), of("bool", F.lit("True")))
        .when(plain.rlike(r"\A(no|No|NO|false|False|FALSE|off|Off|OFF)\z"), of("bool", F.lit("False")))
        .when(plain.rlike(r"\A[-+]?(0|[1-9][0-9_]*)\z"), of("int", F.regexp_replace(plain, r"^\+|_", "")))
        .when(plain.rlike(r"\A[-+]?[0-9][0-9_]*\.[0-9_]*([eE][-+][0-9]+)?\z"), of("float", double))
        .when(plain.rlike(r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}\z"), of("date", plain))
        .otherwise(of("str", plain))
    )


def _item_repr(item: Column) -> Column:
    """One list item as Python's ``repr`` shows it."""
    quote = F.when(F.contains(item["str"], F.lit("'")) & ~F.contains(item["str"], F.lit('"')), F.lit('"')).otherwise(F.lit("'"))
    return F.when(item["type"] == "str", F.concat(quote, item["str"], quote)).otherwise(item["str"])


def entries(front: Column) -> Column:
    """Ordered ``(key, value)`` entries of a flat YAML mapping, JVM-side.

    Scalars, flow lists ``[a, b]`` and block lists are read; nested mappings are kept as text.
    Null frontmatter gives an empty array.
    """
    keys, scalars, blocks = (all_matches(front, ENTRY, g) for g in (1, 2, 3))

    def listed(parts: Column) -> Column:
        items = F.transform(F.filter(parts, lambda p: strip(p) != ""), typed)
        shown = F.concat(F.lit("["), F.array_join(F.transform(items, _item_repr), ", "), F.lit("]"))
        return F.struct(F.lit("list").alias("type"), shown.alias("str"), F.transform(items, lambda i: i["str"]).alias("items"))

    def one(e: Column) -> Column:
        scalar, block = strip(e["scalars"]), e["blocks"]
        flow = F.regexp_extract(scalar, r"(?s)\A\[(.*)\]\z", 1)
        value = (
            F.when(scalar.rlike(r"(?s)\A\[.*\]\z"), listed(F.split(flow, ",")))
            .when((scalar == "") & (block != ""), listed(F.slice(F.split(block, r"\n[ \t]*-[ \t]+"), 2, 1_000_000_000)))
            .otherwise(typed(scalar))
        )
        return F.struct(strip(e["keys"]).alias("k"), value.alias("v"))

    zipped = F.arrays_zip(keys.alias("keys"), scalars.alias("scalars"), blocks.alias("blocks"))
    return F.coalesce(F.transform(zipped, one), F.array().cast(ENTRIES))


def plain_items(items: Column) -> Column:
    """Whether list items need no quotes in a flow list."""
    return F.forall(items, lambda i: i.rlike(r"\A[A-Za-z0-9_][\w ./-]*\z"))


def property_of(fm: Column, key: str) -> Column:
    """The last value of a key among entries, or null."""
    hits = F.filter(fm, lambda e: e["k"] == key)
    return F.when(F.size(hits) > 0, F.element_at(hits, -1)["v"])


# -- body


def frontmatter_tags(fm: Column) -> Column:
    v = property_of(fm, "tags")
    bare = lambda t: F.regexp_replace(t, "^#+", "")
    tags = F.when(v["type"] == "list", F.transform(v["items"], bare)).when(
        v["type"] == "str", F.transform(F.split(v["str"], ","), lambda t: bare(strip(t)))
    )
    return F.coalesce(tags, F.array().cast("array<string>"))


def tags(fm: Column, body: Column) -> Column:
    """Frontmatter tags, then inline ones; the first of equals stays."""
    return F.array_distinct(F.concat(frontmatter_tags(fm), all_matches(body, TAG, 1)))


def wikilinks(body: Column) -> Column:
    return F.array_distinct(all_matches(body, WIKILINK, 1))


def line_count(content: Column) -> Column:
    return F.size(F.split(content, "\n"))


def headers(content: Column, body: Column) -> Column:
    """Level, text and line of every header; the line is that of the first equal text in the note.

    A header's text can only lie where there is a ``#``: such lines are found once (an array of one binds them to
    a name), and each header looks through them alone. One that spans lines is searched for in the whole note.
    """
    zipped = F.arrays_zip(*[all_matches(body, HEADER, g).alias(n) for g, n in ((0, "whole"), (1, "marks"), (2, "words"))])
    numbered = F.transform(F.split(content, "\n"), lambda x, i: F.struct((i + 1).alias("n"), x.alias("x")))
    marked = F.filter(numbered, lambda line: F.contains(line["x"], F.lit("#")))

    def one(h: Column, lines: Column) -> Column:
        here = F.get(F.filter(lines, lambda line: F.contains(line["x"], h["whole"])), F.lit(0))["n"]
        before = F.substring(content, F.lit(1), F.instr(content, h["whole"]) - 1)
        line = F.when(F.contains(h["whole"], F.lit("\n")), F.size(F.split(before, "\n"))).otherwise(here)
        return F.struct(F.length(h["marks"]).alias("level"), strip(h["words"]).alias("text"), line.alias("line_number"))

    return F.get(F.transform(F.array(marked), lambda lines: F.transform(zipped, lambda h: one(h, lines))), F.lit(0))


# -- ids and hashes


def content_hash(c: Column) -> Column:
    return F.substring(F.sha2(c, 256), 1, 32)


def chunk_id(path: Column, index: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws(":", path, index.cast("string")), 256), 1, 16)


def fact_id(path: Column, place: Column, key: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws(":", path, place.cast("string"), key), 256), 1, 16)


def token_estimate(c: Column) -> Column:
    """Deterministic token count: a quarter of the characters, rounded up."""
    return F.ceil(F.length(c) / 4).cast("int")


def strip_fences(c: Column) -> Column:
    """A model's reply without the code fence around it."""
    opened = F.regexp_replace(strip(c), r"\A```[a-zA-Z]*\n?", "")
    return F.when(strip(c).startswith("```"), strip(F.regexp_replace(opened, r"\n?```\s*\z", ""))).otherwise(strip(c))


# -- vectors


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity in doubles; null when a norm is zero."""
    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda s, x: s + x)
    x, y = a.cast("array<double>"), b.cast("array<double>")
    dot = total(F.zip_with(x, y, lambda p, q: p * q))
    norm = lambda v: F.sqrt(total(F.transform(v, lambda p: p * p)))
    scale = norm(x) * norm(y)
    return F.when(scale > 0, dot / scale)
